"""References, patterns, formats and expressions over property columns.

Every property a PV map can emit is known before the scan, so each one is a column and each rule a
plain Catalyst expression guarded by the rule text it belongs to.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.props import valid_sql
from .lookup import PvSchema
from .scale import settle

_FIELD = re.compile(r"\{@?(\w+)(?::([^}]*))?\}")


def prop(name: str) -> Column:
    return F.col(f"`{name}`")


def reference_levels(references: Mapping[str, frozenset[str]]) -> list[list[str]]:
    """Properties in the order in which they are substituted: each after those it refers to.

    Properties that refer to each other in a ring have no such order; they come together once for
    each of them, which carries a value all the way round.
    """
    open_ = {p: {r for r in refs if r in references and r != p} for p, refs in references.items()}
    levels: list[list[str]] = []
    while open_:
        ready = sorted(p for p, refs in open_.items() if not refs & open_.keys())
        if not ready:  # the ring, or rings, that all others wait for
            reach = {p: set(refs) & open_.keys() for p, refs in open_.items()}
            for _ in reach:
                reach = {p: refs | {n for r in refs for n in reach[r]} for p, refs in reach.items()}
            ready = sorted(p for p in open_ if p in reach[p] and all(p in reach[r] for r in reach[p]))
            levels += [ready] * (len(ready) - 1)
        levels.append(ready)
        for p in ready:
            del open_[p]
    return levels


def substitute(df: DataFrame, references: Mapping[str, frozenset[str]]) -> DataFrame:
    """Replace ``@X``, ``{X}`` and ``{@X}`` by the column ``X`` where that is resolved; chains of any length.

    Long chains are settled after every level, so that a level's expressions aren't copied into the next.
    """
    present = set(df.columns)
    levels = reference_levels({p: refs for p, refs in references.items() if p in present})
    for number, level in enumerate(levels):
        changed = {}
        for p in level:
            text = f"`{p}`"
            # an unresolved reference is replaced by itself, so the expression grows by one step per reference
            for r in sorted((r for r in references[p] if r in present), key=lambda r: (-len(r), r)):
                for form in ("{%s}" % r, "{@%s}" % r, "@%s" % r):
                    text = f"replace({text}, '{form}', CASE WHEN {valid_sql(r)} THEN `{r}` ELSE '{form}' END)"
            changed[p] = F.expr(text)
        df = df.withColumns(changed)
        if len(levels) > 3 and number < len(levels) - 1:
            df = settle(df)
    return df


def extract_patterns(df: DataFrame, patterns: Sequence[str], data: str = "Data", rule: str = "#Regex") -> DataFrame:
    """Named groups of the row's own pattern become properties; the last match in the text wins."""
    made: dict[str, list[Column]] = {}
    for text in patterns:
        compiled = re.compile(text)
        java = text.replace("(?P<", "(?<")
        for group, index in compiled.groupindex.items():
            found = F.nullif(F.try_element_at(F.regexp_extract_all(prop(data), F.lit(java), F.lit(index)), F.lit(-1)), F.lit(""))
            made.setdefault(group, []).append(F.when(prop(rule) == text, found))
    if not made or rule not in df.columns:
        return df
    return df.withColumns({g: F.coalesce(*options, *([prop(g)] if g in df.columns else [])) for g, options in made.items()})


def _formatted(template: str, present: set[str]) -> tuple[Column, list[str]]:
    pattern, args, names, at = "", [], [], 0
    for m in _FIELD.finditer(template):
        pattern += template[at:m.start()].replace("%", "%%")
        at = m.end()
        name, spec = m.group(1), m.group(2) or ""
        names.append(name)
        value = prop(name) if name in present else F.lit(None).cast("string")
        if spec.endswith("d"):
            pattern, value = pattern + f"%{spec}", value.try_cast("bigint")
        elif spec.endswith("f"):
            pattern, value = pattern + f"%{spec}", value.try_cast("double")
        else:
            pattern += "%s"
        args.append(value)
    pattern += template[at:].replace("%", "%%")
    ready = F.lit(True)
    for a in args:
        ready = ready & a.isNotNull()
    return F.when(ready, F.format_string(pattern, *args)), names


def apply_formats(df: DataFrame, formats: Sequence[str], rule: str = "#Format") -> DataFrame:
    """``prop={A}-{B:02d}``: fill the template when all its fields are present."""
    if rule not in df.columns:
        return df
    present, made = set(df.columns), {}
    for text in formats:
        if "=" not in text:
            continue
        target, template = text.split("=", 1)
        filled, _ = _formatted(template.strip(), present)
        made.setdefault(target.strip(), []).append(F.when(prop(rule) == text, filled))
    return df.withColumns({t: F.coalesce(*o, *([prop(t)] if t in present else [])) for t, o in made.items()}) if made else df


def apply_expressions(df: DataFrame, expressions: Sequence[str], rule: str = "#Eval") -> DataFrame:
    """``prop=<Spark SQL expression over property columns>``; session functions may be used."""
    if rule not in df.columns:
        return df
    made: dict[str, list[Column]] = {}
    for text in expressions:
        if "=" not in text:
            continue
        target, body = text.split("=", 1)
        made.setdefault(target.strip(), []).append(F.when(prop(rule) == text, F.expr(body.strip()).cast("string")))
    return df.withColumns({t: F.coalesce(*o, *([prop(t)] if t in df.columns else [])) for t, o in made.items()}) if made else df


_ASSIGN = re.compile(r"^\s*([A-Za-z]\w*)\s*:=\s*(.+)$", re.S)


def filter_rules(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> tuple[Column, dict[str, Column]]:
    """Whether a row stays, and the properties that it gets, by its ``#Filter…`` rules.

    Each is a SQL predicate (a null result keeps the row), or ``prop := <expression>``.

    An assignment sets the property where its value is not null and always keeps the row.
    """
    keep, made = F.lit(True), {}
    for name, texts in rules.items():
        if name.startswith("#Filter") and name in df.columns:
            for text in texts:
                assigned = _ASSIGN.match(text)
                if assigned:
                    made.setdefault(assigned.group(1), []).append(F.when(prop(name) == text, F.expr(assigned.group(2)).cast("string")))
                else:
                    keep = keep & F.coalesce(F.when(prop(name) == text, F.expr(text)), F.lit(True))
    return keep, {t: F.coalesce(*o, *([prop(t)] if t in df.columns else [])) for t, o in made.items()}


def apply_filters(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows that their filters keep, with what those assign."""
    keep, made = filter_rules(df, rules)
    kept = df.filter(keep)
    return kept.withColumns(made) if made else kept


def process(df: DataFrame, schema: PvSchema) -> DataFrame:
    """References, then pattern, format and expression rules, then references once more if there are rules."""
    df = substitute(df, schema.references)
    if not any(schema.rules.get(r) for r in ("#Regex", "#Format", "#Eval")):
        return df
    df = extract_patterns(df, schema.rules.get("#Regex", ()))
    df = apply_formats(df, schema.rules.get("#Format", ()))
    df = apply_expressions(df, schema.rules.get("#Eval", ()))
    return substitute(df, schema.references)


def selection(text: str, available: Sequence[str], ignore: Sequence[str] = ()) -> tuple[list[str], dict[str, str]] | None:
    """Properties and fixed values named by a ``a,-b,+c,p=v`` selection; None when it is a plain reference."""
    text = text.strip().strip('"').strip()
    if not text or text[0].isupper() or re.match(r"^[A-Za-z]*:", text):
        return None
    chosen, added, dropped, fixed = [], [], {"measurementDenominator", "variableMeasured"}, {}
    for item in (t.strip() for t in text.split(",")):
        if item.startswith("-"):
            dropped.add(item[1:])
        elif "=" in item:
            name, value = item.lstrip("+").split("=", 1)
            fixed[name] = value
            if not item.startswith("+"):
                chosen.append(name)
        elif item.startswith("+"):
            added.append(item[1:])
        elif item:
            chosen.append(item)
    if not chosen:
        chosen = [a for a in available if a not in ignore]
    names = [n for n in dict.fromkeys(chosen + added) if n not in dropped and n in available and n not in fixed]
    return names, fixed
