"""Column builders over text: character classes, repair, transforms."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FALSE_WORDS, FRACTIONS, LIGATURES, SPACE, TRUE_WORDS
from .patterns import problem_of

SIGNS = "+\u2212\u2013-"

CLASSES = {
    "replacement": r"[\x{FFFD}]",
    "private_use": r"[\x{E000}-\x{F8FF}]",
    "ligatures": r"[\x{FB00}-\x{FB06}]",
    "soft_hyphens": r"[\x{AD}]",
    "combining": r"[\x{300}-\x{36F}]",
}
OUTSIDE = r"[^\x{0}-\x{24F}\x{2000}-\x{206F}]"
CORRUPT = ("replacement", "private_use", "combining")


def count_class(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def signals(text: Column) -> dict[str, Column]:
    """The seven counts of a text; null: zeros."""
    return {"total_chars": F.coalesce(F.char_length(text), F.lit(0)), "outside": count_class(text, OUTSIDE)} | {k: count_class(text, p) for k, p in CLASSES.items()}


def confidence(total: Column, outside: Column, corrupt: Column) -> Column:
    """clamp(1 - 5 * corrupt share - 0.5 * outside share), 0 for no characters."""
    value = 1 - 5 * corrupt / total - outside / total * 0.5
    return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def expand_ligatures(text: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), text)


def remove_soft_hyphens(text: Column) -> Column:
    return F.replace(text, F.lit("­"), F.lit(""))


def normalize_whitespace(text: Column) -> Column:
    """Runs of blanks and tabs become one blank and lines are trimmed; line ends stay."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), "\n")


def strip_odd_characters(text: Column) -> Column:
    """Ligatures expanded; controls but tab and line ends, and the private area, removed."""
    return F.regexp_replace(F.regexp_replace(expand_ligatures(text), r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}]", ""), r"[\x{E000}-\x{F8FF}]", "")


def escape_html(text: Column, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#39;")] if quotes else [])]
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), pairs, text)


def default_value(text: Column, value: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(value))


def parse_number(text: Column) -> Column:
    """The first number of a text, null if none. A sign may stand before it, with blanks between; it is a vulgar fraction with or
    without whole digits before, else digits with or without decimals after a point. Other marks don't group digits."""
    whole_and_mark = "[0-9]*[" + "".join(FRACTIONS) + "]"
    decimal = "[0-9]+([.][0-9]+)?"
    found = F.regexp_substr(text, F.lit(rf"[{SIGNS}]?\s*({whole_and_mark}|{decimal})"))
    body = F.regexp_replace(found, rf"[{SIGNS}]|\s", "")
    mark = F.right(body, F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in FRACTIONS.items() for x in kv])
    part = F.try_element_at(table, mark)
    size = F.when(part.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(body, "[^0-9]", ""), F.lit("")).cast("double"), F.lit(0.0)) + part).otherwise(body.cast("double"))
    return F.when(found.rlike(rf"\A[{SIGNS[1:]}]"), -size).otherwise(size)


def nth_number(text: Column, n: int) -> Column:
    """The n-th number of digits, with its sign and decimals, as it stands; null if there are fewer. Fractions are none."""
    return F.get(F.regexp_extract_all(text, F.lit(rf"[{SIGNS}]?[0-9]+([.][0-9]+)?"), 0), F.lit(n - 1))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def whitespace_only(text: Column) -> Column:
    return (F.length(text) > 0) & (F.length(trimmed(text)) == 0)


def join_wrapped(text: Column) -> Column:
    """Lines as one: a hyphen at the end goes before a small letter a to z, else a blank comes between; empty lines don't count."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    glue = lambda out, x: F.when(out.rlike(r"[-\x{2010}\x{2011}]\z") & x.rlike("\\A[a-z]"), F.concat(F.regexp_replace(out, r".\z", ""), x)).otherwise(F.concat(out, F.lit(" "), x))
    return F.when(F.size(lines) == 0, F.when(text.isNotNull(), "")).otherwise(F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.try_element_at(lines, F.lit(1)), glue))


def regex_extract(text: Column, pattern: str, group: int = 0) -> Column:
    """struct(value, problem): the group of the first match. problem: refused (see patterns.problem_of), no-match, group-missing; null: none."""
    if problem_of(pattern):
        return F.struct(F.lit(None).cast("string").alias("value"), F.when(text.isNotNull(), "refused").alias("problem"))
    groups = re.compile(pattern).groups
    hit = text.rlike(pattern)
    value = F.regexp_extract(text, pattern, group) if group <= groups else F.lit(None).cast("string")
    missing = hit & F.lit(group > groups)
    return F.struct(F.when(hit & ~missing, value).alias("value"), F.when(text.isNull(), None).when(~hit, "no-match").when(missing, "group-missing").alias("problem"))


def split_text(text: Column, separator: str, regex: bool = False) -> Column:
    """Parts between separators, empty ones too; null where the pattern is refused."""
    if regex and problem_of(separator):
        return F.lit(None).cast("array<string>")
    return F.split(text, separator if regex else re.escape(separator).replace("\\ ", " "), -1)


def join_text(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator, "null")


def strip_units(text: Column, unit: str) -> Column:
    """Without the unit in any case, wherever it stands, and the blanks around it."""
    return trimmed(F.regexp_replace(text, r"(?i)\s*" + re.escape(unit) + r"\s*", "")) if unit else text


def regex_replace(text: Column, pattern: str, replacement: str, once: bool = False, ignore_case: bool = False) -> Column:
    """All matches (or the first) replaced; text as it is where the pattern is refused."""
    if problem_of(pattern):
        return text
    found = ("(?i)" if ignore_case else "") + pattern
    if not once:
        return F.regexp_replace(text, found, replacement)
    at = F.regexp_instr(text, F.lit(found))
    hit = F.coalesce(F.regexp_substr(text, F.lit(found)), F.lit(""))  # a match may be empty
    head = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.concat(head, F.regexp_replace(hit, found, replacement), F.substring(text, at + F.length(hit), F.length(text)))).otherwise(text)


def dice_notation(text: Column) -> Column:
    """Without blanks, small d, one blank around signs."""
    return trimmed(F.regexp_replace(F.replace(F.regexp_replace(text, r"\s+", ""), F.lit("D"), F.lit("d")), "([+-])", " $1 "))


STEPS = {
    "trim": trimmed, "normalizeWhitespace": normalize_whitespace, "joinWrappedLines": join_wrapped, "stripLigaturesAndOddChars": strip_odd_characters,
    "regexExtract": lambda c, pattern, group=0: regex_extract(c, pattern, group)["value"], "parseNumber": parse_number, "nthNumber": nth_number, "split": split_text, "join": join_text,
    "stripUnits": strip_units, "regexReplace": regex_replace, "diceNotation": dice_notation, "defaultValue": default_value,
}


def run_chain(text: Column, steps: list[dict]) -> Column:
    """A chain of steps (kind and its parameters) as one expression; a step that fails hands null to the next."""
    for step in steps:
        text = STEPS[step["kind"]](text, **{k: v for k, v in step.items() if k != "kind"})
    return text


def cast_and_validate(text: Column, kind: str, *, least: float | None = None, most: float | None = None, integer: bool = False, choices: tuple[str, ...] = ()) -> Column:
    """struct(value string, problems array): a text as number, string, html, boolean or one of choices.

    What can't be cast is null and an error; a number out of its bounds or not whole, and a choice not offered, stay with a warning. Null: null, without problems.
    """
    none = F.lit(None).cast("string")
    if kind == "number":
        number = parse_number(text)
        checks = [(number.isNull(), "not-number"), (F.lit(integer) & (number != F.floor(number)), "not-integer")]
        checks += [(number < least, "below-min")] if least is not None else []
        checks += [(number > most, "above-max")] if most is not None else []
        value = number.cast("string")
    elif kind == "boolean":
        word = F.lower(trimmed(text))
        value = F.when(word.isin(*TRUE_WORDS), "true").when(word.isin(*FALSE_WORDS), "false")
        checks = [(value.isNull(), "not-boolean")]
    elif kind == "choices":
        value, checks = text, [(~text.isin(*choices), "not-in-choices")] if choices else []
    elif kind in ("string", "html"):
        value, checks = text, []
    else:
        raise ValueError(f"a text has no cast to {kind}")
    problems = F.array_compact(F.array(none, *[F.when(when, name) for when, name in checks]))
    return F.struct(F.when(text.isNotNull(), value).alias("value"), F.when(text.isNull(), F.array().cast("array<string>")).otherwise(problems).alias("problems"))
