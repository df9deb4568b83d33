"""What a connector resource looks like to the sync engine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

# Merge key and cursor of each connector; None where the user chooses.
CONNECTOR_KEYS: dict[str, tuple[str | None, str | None]] = {
    "asaas": ("id", "dateCreated"),
    "salesforce": ("Id", "LastModifiedDate"),
    "hubspot": ("id", "hs_lastmodifieddate"),
    "jira": ("id", "updated"),
    "zendesk": ("id", "updated_at"),
    "clickup": ("id", "date_updated"),
    "confluence": ("id", "version_when"),
    "notion": ("id", "last_edited_time"),
    "slack": ("message_key", "ts"),
    "google_analytics": ("date", "date"),
    "microsoft365": ("doc_id", "modified_at"),
    "google_drive": ("doc_id", "modified_at"),
    "airtable": ("record_id", None),
    "postgres": (None, None),
    "mysql": (None, None),
    "bigquery": (None, None),
    "mongodb": ("_id", None),
}
# Resources that differ from their connector's key or cursor.
RESOURCE_KEYS: dict[tuple[str, str], tuple[str | None, str | None]] = {
    ("asaas", "transfers"): ("id", "transferDate"),
    ("jira", "users"): ("account_id", None),
    ("airtable", "comments"): ("comment_id", None),
}
# Resources that are read whole every time.
ALWAYS_FULL = {
    ("asaas", "subscriptions"),
    ("clickup", "members"), ("clickup", "lists"), ("clickup", "spaces"),
    ("jira", "projects"), ("jira", "users"), ("jira", "comments"),
    ("zendesk", "comments"),
}
ALWAYS_FULL_SUFFIX = {"hubspot": "_associations"}
# Tables that several sub-resources share.
CONSOLIDATED = {("notion", "pages"), ("confluence", "pages"), ("slack", "messages")}
# Connectors whose key names a group of rows (a day), not one row.
GROUP_KEYED = {"google_analytics"}


@dataclass(frozen=True)
class ResourceConfig:
    """Mode, cursor and key of one resource.

    ``partition`` names the column that has a cursor of its own per value; ``stamp`` adds a
    row id and the load time to every row.
    """

    connector: str
    resource: str
    mode: str = "full_refresh"
    cursor: str | None = None
    pk: Sequence[str] = field(default_factory=tuple)
    supports_incremental: bool = True
    consolidated: bool = False
    unique: bool = True
    partition: str | None = None
    lookback: object | None = None
    stamp: bool = False

    @property
    def table(self) -> str:
        return f"{self.connector}__{self.resource}"


def default_config(connector: str, resource: str, mode: str = "incremental", **chosen) -> ResourceConfig:
    """Config from the registry; ``pk`` and ``cursor`` may be chosen for dynamic schemas."""
    if connector not in CONNECTOR_KEYS:
        raise ValueError(f"unknown connector: {connector}")
    pk, cursor = RESOURCE_KEYS.get((connector, resource), CONNECTOR_KEYS[connector])
    full = (connector, resource) in ALWAYS_FULL or (
        connector in ALWAYS_FULL_SUFFIX and resource.endswith(ALWAYS_FULL_SUFFIX[connector])
    )
    values = {
        "mode": mode,
        "pk": (pk,) if pk else (),
        "cursor": cursor,
        "supports_incremental": not full,
        "consolidated": (connector, resource) in CONSOLIDATED,
        "unique": connector not in GROUP_KEYED,
        **chosen,
    }
    return ResourceConfig(connector, resource, **values)


def derive_mode(config: ResourceConfig, columns: Sequence[str]) -> str:
    """``merge`` when cursor and key are declared and incremental is wanted, else ``overwrite``.

    Declared columns that the table lacks are an error, never a silent full load. A
    consolidated table is always merged, or its sibling resources would be erased.
    """
    if config.mode not in ("incremental", "full_refresh"):
        raise ValueError(f"unknown mode: {config.mode}")
    declared = [*config.pk, *([config.cursor] if config.cursor else [])]
    incremental = config.mode == "incremental" and config.supports_incremental
    if incremental or config.consolidated:
        missing = [c for c in declared if c not in columns]
        if missing:
            raise ValueError(f"{config.table} lacks declared columns: {', '.join(missing)}")
    if config.consolidated:
        if not config.pk:
            raise ValueError(f"consolidated table {config.table} needs a key")
        return "merge"
    if incremental and config.cursor and config.pk:
        return "merge"
    return "overwrite"
