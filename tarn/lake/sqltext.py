"""What a SQL text names, read from Spark's own parsed plan."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class ParsedQuery:
    """Plan nodes by class name, the relations and functions named, and the names a WITH defines."""

    nodes: list = field(default_factory=list)
    relations: list[tuple[str, ...]] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    defined: set[str] = field(default_factory=set)


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def parsed_query(spark, text: str) -> ParsedQuery:
    """Walks plans, their expressions and the plans inside these, at any depth and width."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    found, open_nodes = ParsedQuery(), [(plan, True)]
    while open_nodes:
        node, is_plan = open_nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            found.relations.append(tuple(map(str, _items(node.multipartIdentifier()))))
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            name = node.nameParts() if kind == "UnresolvedFunction" else node.name()
            found.functions.append(str(_items(name)[-1]).lower())
        elif kind == "UnresolvedWith":
            for relation in _items(node.cteRelations()):
                found.defined.add(str(relation._1()).lower())
                open_nodes.append((relation._2(), True))
        if is_plan:
            found.nodes.append(node)
            open_nodes += [(e, False) for e in _items(node.expressions())]
        elif "plan" in dir(node) and hasattr(node, "plan"):
            open_nodes.append((node.plan(), True))
        open_nodes += [(c, is_plan) for c in _items(node.children())]
        if is_plan:
            open_nodes += [(c, True) for c in _items(node.innerChildren()) if hasattr(c, "expressions")]
    return found
