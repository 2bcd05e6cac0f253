"""What is shown of a model's answer, and what it is given: headings, follow-up questions, tables of known nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't count against a heading's capitals.
SMALL_WORDS = "and or the a an of to for in on with".split()


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(c: Column) -> Column:
    return F.split(c, r"\R")


def _is_title(line: Column) -> Column:
    """Two words or more of letters, digits and a little punctuation, three quarters of them with a capital or small words."""
    words = F.split(line, r"\s+")
    fits = F.filter(words, lambda w: F.lower(F.regexp_replace(w, "^[\"'()]+|[\"'()]+$", "")).isin(SMALL_WORDS) | w.rlike("^[A-Z]"))
    return line.rlike(r"^[A-Z][A-Za-z0-9 \"'\-()]+$") & (F.char_length(line) <= 64) & (F.size(words) >= 2) & (4 * F.size(fits) >= 3 * F.size(words))


def with_headings(text: Column) -> Column:
    """A line that stands after an empty one and before a full one, and looks like a title, becomes a heading."""
    blank = lambda c: _stripped(F.coalesce(c, F.lit(""))) == ""

    def marked(lines):
        heads = lambda line, i: ((i == 0) | blank(F.get(lines, i - 1))) & ~blank(F.get(lines, i + 1)) & _is_title(_stripped(line))
        return F.transform(lines, lambda line, i: F.when(heads(line, i), F.concat(F.lit("### "), _stripped(line))).otherwise(line))

    return F.array_join(_once(_lines(text), marked), "\n")


def split_follow_ups(text: Column) -> Column:
    """struct<text, follow_ups>: what stands before a section of follow-up questions, and those of its lines that end in a question mark.

    With fewer than two such lines it isn't taken for such a section.
    """
    none = F.array().cast("array<string>")

    def parts(lines):
        at = F.coalesce(F.get(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"(?i)follow\s*-?\s*up\s+questions"), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(lines))
        asked = F.filter(F.transform(F.filter(lines, lambda x, i: i > at), _stripped), lambda x: F.endswith(x, F.lit("?")))
        bare = F.filter(F.transform(asked, lambda x: _stripped(F.regexp_replace(x, r"^[-*\d.)\s]+", ""))), lambda x: x != "")
        before = F.regexp_replace(F.array_join(F.slice(lines, F.lit(1), at), "\n"), r"\s+$", "")
        found = F.size(asked) >= 2
        return F.struct(F.when(found, before).otherwise(text).alias("text"), F.when(found, bare).otherwise(none).alias("follow_ups"))

    return _once(_lines(text), parts)


def cleaned(text: Column) -> Column:
    """struct<text, follow_ups> of an answer without its opening interjection and its block of key connections, with headings."""
    raw = F.regexp_replace(_stripped(F.coalesce(text, F.lit(""))), r"(?i)^(wuh\s*-?\s*loss)[\s,!.:-]+", "")
    raw = _stripped(F.regexp_replace(raw, r"(?imsd)^\s*#{0,6}\s*key connections\s*$\n(?:^\s*[-*]\s.*\n)+\n?", ""))
    return _once(with_headings(raw), split_follow_ups)


def node_line(id_: Column, kind: Column, label: Column, aliases: Column) -> Column:
    """A row of the table of known nodes, with three aliases at most."""
    cells = [F.coalesce(c, F.lit("")) for c in (id_, kind, label, F.array_join(F.slice(aliases, 1, 3), ", "))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def node_table(lines: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit("| ID | Type | Label | Aliases |"), F.lit("|---|---|---|---|")), lines), "\n")


def speaker_list(speakers: Column) -> Column:
    """Known speakers, an array of struct<id, name>, one a line."""
    lines = F.transform(speakers, lambda s: F.concat(F.lit("- "), s["id"], F.lit(": "), s["name"]))
    return F.when(F.size(F.coalesce(lines, F.array().cast("array<string>"))) == 0, "No previous speakers identified.").otherwise(F.array_join(lines, "\n"))
