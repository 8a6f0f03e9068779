"""Free text to template: ordered regular-expression rewrites as column expressions.

A rule is (name, pattern, replacement). Rules run as a left fold, so a later rule sees the output
of the earlier ones. Everything stays inside generated code; no Python runs per row.
"""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.text import UNICODE, blank_to_null, strip


# What a text must hold for a rule of the tables to change it. A search for fixed text costs a small part of a search by
# pattern, and most rules concern few texts. Letters with further cases (i, k, s) are left out where a rule ignores case.
_NEEDED = dict(
    zip(
        [*V.DATASTORE_RULES, *V.FIELD_RULES[:-1], *V.SECOND_PASS_RULES[:2], V.SECOND_PASS_RULES[3]],
        ["/volume", ".naa.", "vol", "z", "-", ".", "0x", "cpu", "dlx:", "opid=", "sid=", "lro-", "task-", ".", '"', "-"],
        strict=True,
    )
)
_BOUND = re.compile(r"(\(\?i\))?\\b(?:([a-z]|\\d|\[[\w-]+\])(?![?*]|\{0)|\((?:\?:)?((?:[a-z]+\|)*[a-z]+)\)(?![?*]|\{0))")


def bounded(pattern: str) -> str:
    """The same matches with the first sign asked for before the word boundary.

    A Unicode word boundary looks up the classes of two signs at every place of a text, most of which do not begin a match."""
    found = _BOUND.match(pattern)
    if found is None:
        return pattern
    flags, sign, words = found.groups(default="")
    first = sign or f"[{''.join(sorted({w[0] for w in words.split('|')}))}]"
    return f"{flags}(?={first}){pattern[len(flags):]}"


def apply_rule(text: Column, rule: tuple[str, str, str]) -> Column:
    _, pattern, replacement = rule
    if rule not in _NEEDED:
        return F.regexp_replace(text, UNICODE + bounded(pattern), replacement)

    def changed(t: Column) -> Column:
        held = F.lower(t) if pattern.startswith("(?i)") else t
        return F.when(held.contains(_NEEDED[rule]), F.regexp_replace(t, UNICODE + bounded(pattern), replacement)).otherwise(t)

    # An array of one names the text, so that the rules before it are not spelled and run three times.
    return F.get(F.transform(F.array(text), changed), F.lit(0))


def apply_rules(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    return reduce(apply_rule, rules, text)


def collapse_spaces(text: Column) -> Column:
    # Every run of white space but a single blank, which would become itself.
    return F.trim(F.regexp_replace(text, UNICODE + r" \s+|[\s&&[^ ]]\s*", " "))


def mask_hosts(text: Column, host_pattern: str) -> Column:
    """Lower-case, then replace host names. Null and empty pass through."""
    return F.regexp_replace(F.lower(text), UNICODE + bounded("(?i)" + host_pattern), "<HOST>")


def mask_datastores(text: Column) -> Column:
    return apply_rules(text, V.DATASTORE_RULES)


def mask_fields(text: Column) -> Column:
    """Time stamps, ids, addresses and numbers of lower-cased text."""
    return apply_rules(text, V.FIELD_RULES)


def repair_placeholders(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), V.PLACEHOLDER_CASE, text)


def template_of(message: Column, host_pattern: str) -> Column:
    """The collector's full chain. A null message counts as empty text."""
    masked = mask_datastores(mask_hosts(F.coalesce(message, F.lit("")), host_pattern))
    return repair_placeholders(collapse_spaces(mask_fields(F.lower(masked))))


def second_pass(template: Column) -> Column:
    """The labeling chain on top of a template. Null, empty or blank templates give null."""
    text = blank_to_null(strip(template))
    return collapse_spaces(apply_rules(text, V.SECOND_PASS_RULES))
