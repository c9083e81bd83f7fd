"""Scalar expressions: names, odds, guarded arithmetic. All are built-in Catalyst expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-word name suffixes that a canonical name loses.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]


def _folds() -> tuple[str, str, str]:
    """Characters whose compatibility decomposition has exactly one ASCII character (in the first plane), and that character; and all others that
    have any, each with what it has, as the text of a map."""
    every = ((chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if ord(x) < 128)) for c in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)))
    pairs = [(a, b) for a, b in every if b]
    one = [(a, b) for a, b in pairs if len(b) == 1 and a < "\ud800"]
    rest = [(a, b) for a, b in pairs if len(b) != 1 or a >= "\ud800"]
    return "".join(a for a, _ in one), "".join(b for _, b in one), "\x02".join(f"{a}\x01{b}" for a, b in rest)


_FROM, _TO, _REST = _folds()


def ascii_fold(text: Column) -> Column:
    """The ASCII characters of the text's compatibility decomposition. Only texts that hold anything else once single letters have lost their
    accents are gone through character by character."""
    plain = F.translate(text, _FROM, _TO)
    rest = F.str_to_map(F.lit(_REST), F.lit("\x02"), F.lit("\x01"))  # a constant
    letters = F.transform(F.split(plain, ""), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(rest, c), F.lit(""))))
    return F.when(F.rlike(plain, F.lit(r"[^\x00-\x7F]")), F.array_join(letters, "")).otherwise(plain)


def canonical_name(name: Column) -> Column:
    """Lower case, no accents, no other characters than ASCII, no periods or apostrophes, no suffix words; null gives ''."""
    plain = ascii_fold(F.lower(F.trim(F.coalesce(name, F.lit("")))))
    return F.trim(F.regexp_replace(F.translate(plain, ".'", ""), rf"\b({'|'.join(SUFFIXES)})\b", ""))


def light_name(name: Column) -> Column:
    """Lower case, no periods or apostrophes, each suffix removed once from the end, in order; null or empty gives unknown_player."""
    out = F.translate(F.lower(F.trim(name)), ".'", "")
    for s in SUFFIXES:
        out = F.regexp_replace(out, f" {s}$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown_player")).otherwise(out)


def american_odds(text: Column) -> Column:
    """+105, -110 (also with a minus sign or a dash), EVEN; anything else 0."""
    plain = F.translate(F.trim(text), "−–+", "--")
    number = plain.try_cast("double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("int")
    return F.coalesce(F.when(F.upper(F.trim(text)) == "EVEN", F.lit(100)).otherwise(whole), F.lit(0))


def signed_odds(odds: Column) -> Column:
    return F.when(odds > 0, F.concat(F.lit("+"), odds.cast("string"))).otherwise(odds.cast("string"))


def guarded_ratio(a: Column, b: Column, digits: int = 3) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(F.lit(0.0))


def number_or_zero(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(x, r"\s+"), lambda t: t != "")), " ")


def _bit_lcs(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence, a bit for each character of a (61 at most)."""
    ones = F.expr("shiftleft(1L, 0)")
    full = (F.pow(F.lit(2.0), F.length(a)).cast("long") - 1).cast("long")
    at = F.transform(_chars(a), lambda c, i: F.struct(c.alias("c"), F.call_function("shiftleft", ones, i).alias("m")))

    def step(s, c):
        mask = F.aggregate(at, F.lit(0).cast("long"), lambda m, x: F.when(x["c"] == c, m.bitwiseOR(x["m"])).otherwise(m))
        both = s.bitwiseAND(mask)
        return (s + both).bitwiseOR(s - both).bitwiseAND(full)

    return F.aggregate(_chars(b), full, step, lambda s: F.length(a) - F.bit_count(s))


def _table_lcs(a: Column, b: Column) -> Column:
    """The same for names of any length, a row of the usual table for each character of b."""
    own = _chars(a)

    def row(old, c):
        def cell(new, j):
            return F.concat(new, F.array(F.when(F.element_at(own, j) == c, F.element_at(old, j) + 1).otherwise(F.greatest(F.element_at(old, j + 1), F.element_at(new, -1)))))

        return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.array(F.lit(0)), cell)

    return F.aggregate(_chars(b), F.array_repeat(F.lit(0), F.length(a) + 1), row, lambda last: F.element_at(last, -1))


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


#: Characters of the shorter name up to which its positions are bits of a long.
BITS = 61


def indel_score(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (length a + length b): bit-parallel where the shorter name has at most 61 characters, by table beyond. Empty strings: 0."""
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    lcs = F.when(F.length(short) <= BITS, _bit_lcs(short, long)).otherwise(_table_lcs(short, long))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.lit(200.0) * lcs / (F.length(a) + F.length(b))).otherwise(F.lit(0.0))


#: Names that books use, and the names in the player table (both canonical).
ALIASES = {
    "nic claxton": "nicolas claxton",
    "kj martin": "kenyon martin",
    "mo bamba": "mohamed bamba",
    "cam thomas": "cameron thomas",
    "chuma okeke": "chukwuma okeke",
    "guillermo hernangomez": "willy hernangomez",
    "juancho hernangomez": "juan hernangomez",
    "xnba": "unknown",
    "alexandre sarr": "alex sarr",
}


def aliased(name: Column, aliases: dict[str, str]) -> Column:
    """The name in the player table for a canonical name that has another one in the books."""
    if not aliases:
        return name
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), name)


def teams_wanted(team: Column, options: Column) -> Column:
    """The teams that a row names, of its own and of its options; empty ones and UNK name none."""
    given = F.concat(F.array(team), F.coalesce(options, F.array().cast("array<string>")))
    return F.filter(F.array_distinct(given), lambda t: t.isNotNull() & ~t.isin("", "UNK"))


def listed(text: Column) -> Column:
    """The strings in a list literal such as ['BOS', "LAL"]; no brackets: none."""
    found = F.regexp_extract_all(text, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0))
    plain = F.transform(found, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(F.contains(text, F.lit("[")), plain).otherwise(F.array().cast("array<string>"))


def until_stop(text: Column, stops: list[str]) -> Column:
    """The tokens before the first that is a stop word or all digits, joined by spaces."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    stop = F.array_position(F.transform(tokens, lambda t: t.isin(*stops) | F.regexp_like(t, F.lit("^[0-9]+$"))), F.lit(True)).cast("int")
    return F.array_join(F.when(stop > 0, F.slice(tokens, F.lit(1), stop - 1)).otherwise(tokens), " ")


def before_last(text: Column, sep: str) -> Column:
    """What stands before the last separator; null where there is none."""
    tail = F.length(F.substring_index(text, sep, -1)) + len(sep)
    return F.when(F.contains(text, F.lit(sep)), F.substring(text, F.lit(1), F.length(text) - tail))


def first_contained(text: Column, table: dict[str, str], otherwise: Column) -> Column:
    """The value of the first key, in the table's order, that text contains."""
    out = None
    for k, v in table.items():
        hit = F.contains(text, F.lit(k))
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(otherwise)


#: The statistic behind each tab's label.
TABS = {
    "Points": "PTS", "Assists": "AST", "Rebounds": "REB", "Threes": "FG3M", "Pts+Ast": "PTS+AST", "Pts+Reb": "PTS+REB", "Reb+Ast": "REB+AST", "Pts+Reb+Ast": "PTS+REB+AST", "Fantasy": "FAN", "Blocks": "BLK", "Steals": "STL", "Turnovers": "TOV",
}


def tab_stat(label: Column) -> Column:
    """The statistic of a tab; PTS for tabs without one."""
    known = F.create_map(*(F.lit(x) for pair in TABS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, label), F.lit("PTS"))


def signed_diff(x: Column) -> Column:
    """A difference as text with one digit: + before a positive one, - for none at all."""
    shown = F.round(x, 1).cast("decimal(18,1)").cast("string")
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, "-").when(x > 0, F.concat(F.lit("+"), shown)).otherwise(shown)
