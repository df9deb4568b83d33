"""Column functions; all of them native expressions, none of them Python UDFs."""

from tarn.functions.identity import (
    is_valid_cnpj,
    is_valid_cpf,
    is_valid_email,
    normalize_field,
    normalize_phone,
    only_digits,
)
from tarn.functions.ids import (
    content_hash,
    external_id,
    load_stamp,
    row_fingerprint,
    row_id,
    synthetic_key,
    uuid5,
)
from tarn.functions.json_records import parse_record, struct_type
from tarn.functions.scalars import (
    add_days,
    age_in_days,
    beyond,
    bucket_of,
    email_domain,
    normalize_email,
    path_basename,
    round_money,
    tier_of,
    to_utc,
    watermark_or,
)

__all__ = [
    "add_days", "age_in_days", "beyond", "bucket_of", "content_hash", "email_domain", "external_id",
    "is_valid_cnpj", "is_valid_cpf", "is_valid_email", "load_stamp", "normalize_email",
    "normalize_field", "normalize_phone", "only_digits", "parse_record", "path_basename",
    "round_money", "row_fingerprint", "row_id", "struct_type", "synthetic_key", "tier_of",
    "to_utc", "uuid5", "watermark_or",
]
