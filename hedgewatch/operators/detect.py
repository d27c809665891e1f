"""Rule evaluation over the access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewatch.functions.literals import FOLDED, roots, shared_pattern
from hedgewatch.functions.once import with_columns_once
from hedgewatch.functions.text import quoted
from hedgewatch.sources.rules import BUILTIN, RULE_COLUMNS

HIT = "struct<place:int,name:string,score:double,attack_type:string>"
#: Imported rules that are passed over together.
GROUP = 25
#: Rules whose hits are bits of one number, and numbers at most. The JVM compiles no method of more than 8,000 bytes, and the tests of
#: one number become one method.
BITS, NUMBERS = 7, 9
FIELDS = ("path", "query_string", "content", "user_agent")


def any_text(columns: list[str]) -> Column:
    """Path, then query, content and user agent where not empty, space-joined."""
    parts = [f"nullif({c}, '')" for c in FIELDS[1:] if c in columns]
    return F.expr(f"concat_ws(' ', coalesce(path, ''), {', '.join(parts)})")


def apply_rules(access_log: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Add ``matched_rules``, ``attack_types``, ``rule_score``, ``primary_type``
    and ``matched``. Without ``rules`` the built-in ones apply.

    The rule table is configuration (hundreds of rows), so it is read once on the
    driver and becomes literal patterns in one projection: no join, no shuffle,
    and each pattern is compiled once per task. The hits are evaluated once, even
    below later filters on the score. Rules with ``needles`` are only tried on
    texts that contain one: built-in rules look for their own, those of all imported
    rules are found together, by one pattern per text.
    """
    if rules is None:
        listed = [dict(zip(RULE_COLUMNS, row)) for row in BUILTIN]
    else:
        listed = [row.asDict() for row in rules.orderBy("ordinal").collect()]
    value = {c: c for c in FIELDS if c in access_log.columns} | {"any": "__any"}
    listed = [rule for rule in listed if rule["field"] in value]
    linked = [(i, rule) for i, rule in enumerate(listed) if rule["needles"] and rule["source"] != "custom"]
    alone = [(i, rule) for i, rule in enumerate(listed) if not rule["needles"] or rule["source"] == "custom"]

    text = access_log.withColumn("__any", any_text(access_log.columns)).selectExpr(
        # every field is part of this text; lower-casing is plain only for ASCII
        "*", "lower(__any) AS __low", "length(__any) = octet_length(__any) AS __plain")
    kept = [f"`{c}`" for c in access_log.columns]
    if alone and not linked and len(alone) <= BITS * NUMBERS:
        return _from_bits(text, [(rule, _matches(rule, value[rule["field"]])) for _, rule in alone], kept)
    hits = f"array_compact(array({', '.join(_test(i, rule, value[rule['field']]) for i, rule in alone)}))"
    if linked:
        root = roots(n for _, rule in linked for n in rule["needles"])
        folded = f"IF(__plain, __low, lower(translate(__any, {quoted(FOLDED[0])}, {quoted(FOLDED[1])})))"
        pattern = quoted(shared_pattern(sorted(set(root.values()))))
        text = with_columns_once(text, {"__found": F.expr(f"array_distinct(regexp_extract_all({folded}, {pattern}, 1))")})
        hits = f"array_sort(concat({hits}, {_linked_tests(linked, root, value)}))"
    found = with_columns_once(text, {"__hits": F.expr(f"CAST({hits} AS ARRAY<{HIT}>)")})
    return found.selectExpr(
        *kept,
        "__hits.name AS matched_rules",
        "array_distinct(__hits.attack_type) AS attack_types",
        "greatest(coalesce(array_max(__hits.score), 0.0D), 0.0D) AS rule_score",
        "coalesce(get(__hits, 0).attack_type, '') AS primary_type",
        "size(__hits) > 0 AS matched",
    )


def _matches(rule: dict, value: str) -> str:
    """SQL for whether a rule matches."""
    matches = f"{value} RLIKE {quoted(rule['pattern'])}"
    if rule.get("needles") and rule["source"] == "custom":
        possible = " OR ".join(f"contains(__low, {quoted(n)})" for n in rule["needles"])
        matches = f"(NOT __plain OR {possible}) AND {matches}"
    return matches


def _from_bits(text: DataFrame, rules: list[tuple[dict, str]], kept: list[str]) -> DataFrame:
    """The columns of ``apply_rules`` from few numbers per event, a bit for each rule that matches. Tests are compiled that way, names
    and types are only listed for events that a later filter keeps."""
    found, hit = text, []
    for start in range(0, len(rules), BITS):
        number, group = f"__bits{start}", rules[start:start + BITS]
        found = with_columns_once(found, {number: F.expr(" | ".join(f"IF({matches}, {1 << i}, 0)" for i, (_, matches) in enumerate(group)))})
        hit += [(f"({number} & {1 << i}) <> 0", rule) for i, (rule, _) in enumerate(group)]

    def listed(name: str) -> str:
        return f"array_compact(array({', '.join(f'IF({bit}, {quoted(rule[name])}, NULL)' for bit, rule in hit)}))"

    scores = ", ".join(f"IF({bit}, {float(rule['score'])!r}D, 0.0D)" for bit, rule in hit)
    return found.selectExpr(
        *kept,
        f"{listed('name')} AS matched_rules",
        f"array_distinct({listed('attack_type')}) AS attack_types",
        f"greatest({scores}, 0.0D) AS rule_score",
        f"CASE {' '.join(f'WHEN {bit} THEN ' + quoted(rule['attack_type']) for bit, rule in hit)} ELSE '' END AS primary_type",
        f"{' OR '.join(f'__bits{start} <> 0' for start in range(0, len(rules), BITS))} AS matched",
    )


def _test(place: int, rule: dict, value: str) -> str:
    """SQL for the hit of one rule, NULL if it does not match."""
    return (f"CASE WHEN {_matches(rule, value)} THEN named_struct('place', {place}, 'name', {quoted(rule['name'])}, "
            f"'score', {float(rule['score'])!r}D, 'attack_type', {quoted(rule['attack_type'])}) END")


def _linked_tests(linked: list[tuple[int, dict]], root: dict[str, str], value: dict[str, str]) -> str:
    """SQL for the hits of rules whose needles are looked up in ``__found``. Rules with like needles stand together, and a group
    is passed over where none of its needles was found, so that a text without any costs no rule at all."""
    needs = sorted(((sorted({root[n] for n in rule["needles"]}), place, rule) for place, rule in linked), key=lambda x: x[:2])
    groups = []
    for start in range(0, len(needs), GROUP):
        group = needs[start:start + GROUP]
        tests = ", ".join(f"CASE WHEN {_any_found(roots_)} THEN {_test(place, rule, value[rule['field']])} END"
                          for roots_, place, rule in group)
        groups.append(f"IF({_any_found(sorted({r for roots_, _, _ in group for r in roots_}))}, "
                      f"array_compact(array({tests})), CAST(array() AS ARRAY<{HIT}>))")
    return f"IF(size(__found) > 0, concat({', '.join(groups)}), CAST(array() AS ARRAY<{HIT}>))"


def _any_found(texts: list[str]) -> str:
    if len(texts) == 1:
        return f"array_contains(__found, {quoted(texts[0])})"
    return f"arrays_overlap(__found, array({', '.join(map(quoted, texts))}))"


def rule_hits(detected: DataFrame) -> DataFrame:
    """Long form, one row per event and matched rule, in rule order."""
    return detected.select("line_number", F.posexplode("matched_rules").alias("position", "rule"))
