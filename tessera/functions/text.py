"""String functions of parsing, formatting and prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def verdict(text: Column) -> Column:
    """1 or 0 from a judge's reply (the pattern of a labelled answer is a fixed value): a labelled answer, else the last line that is only YES or NO, else the first such word, else 0."""
    labelled = F.regexp_extract(text, r"(?i)\b(?:Final\s+)?Answer\s*:\s*\**\s*(YES|NO)\b", 1)
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.upper(F.regexp_replace(x, r"[\s`*_]", "")))
    alone = F.get(F.filter(F.reverse(lines), lambda x: x.isin("YES", "NO")), F.lit(0))
    token = F.regexp_extract(F.upper(text), r"\b(YES|NO)\b", 1)
    pick = F.coalesce(F.nullif(F.upper(labelled), F.lit("")), alone, F.nullif(token, F.lit("")), F.lit("NO"))
    return (pick == "YES").cast("int")


def stripped(text: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def answer_split(text: Column) -> Column:
    """struct(answer, rationale): cut at the first "rationale:"; with nothing before it, the rest is the answer and there is no rationale."""
    parts = F.split(text, r"(?i)rationale:", 2)
    left, right = stripped(F.get(parts, F.lit(0))), stripped(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return F.struct(F.when(left == "", right).otherwise(left).alias("answer"), F.when(left == "", F.lit("")).otherwise(right).alias("rationale"))


def strip_fence(text: Column) -> Column:
    """The text inside a code fence, or the text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def ordinal(n: Column) -> Column:
    tens, ones = F.abs(n) % 100, F.abs(n) % 10
    return F.concat(n.cast("string"), F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th"))


def half_minute_phrase(seconds: Column) -> Column:
    """"around N minutes" at the nearest half minute."""
    halves = F.bround(seconds / F.lit(30.0), 0).cast("long")
    whole = F.floor(halves / 2).cast("long")
    number = F.when(halves % 2 == 1, F.concat(whole.cast("string"), F.lit(" and a half"))).otherwise(whole.cast("string"))
    return F.concat(F.lit("around "), number, F.when((halves % 2 == 0) & (whole == 1), " minute").otherwise(" minutes"))


def topic(text: Column) -> Column:
    """Lower case, but for words of capitals."""
    word = lambda w: F.when((F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)), w).otherwise(F.lower(w))
    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), word), " ")


def clauses(text: Column) -> Column:
    """Clauses of a text: cut after sentence ends and at commas that white space follows, trimmed, none empty."""
    cut = F.split(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0001"), F.lit(" ")), r"(?:([.!?])|,)\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, stripped), lambda x: x != "")


def picked_clause(text: Column, draw: Column, least: int = 4, most: int = 12) -> Column:
    """The clause that ``draw`` (a number from 0) picks among those of ``least`` to ``most`` words, or among all if none has so many; '' without any."""
    all_ = clauses(text)
    fits = F.filter(all_, lambda x: F.size(F.split(x, r"\s+")).between(least, most))
    pool = F.when(F.size(fits) > 0, fits).otherwise(all_)
    return F.when(F.size(pool) > 0, F.get(pool, F.pmod(draw, F.greatest(F.size(pool), F.lit(1))).cast("int"))).otherwise("")


def token_overlap(a: Column, b: Column) -> Column:
    """Number of different lower-case words that two texts share."""
    split = lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")
    return F.size(F.array_intersect(F.array_distinct(split(a)), F.array_distinct(split(b))))


def truncated(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def slug(model: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(model, "/"), -1), r"[^A-Za-z0-9.-]+", "_")


def clock_seconds(text: Column) -> Column:
    """mm:ss or h:mm:ss to seconds, null if it is neither."""
    p = F.split(F.trim(text), ":")
    n = lambda k: F.get(p, F.lit(k)).try_cast("int")
    s = lambda k: F.get(p, F.lit(k)).try_cast("double")
    return F.when(F.size(p) == 2, n(0) * 60 + s(1)).when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + s(2))


def option_text(options: Column, answer: Column) -> Column:
    """The option that an answer "(x) ..." names by its letter; else the answer."""
    letter = F.lower(F.regexp_extract(answer, r"^\s*\(([a-zA-Z])\)", 1))
    return F.coalesce(F.get(F.filter(options, lambda o: F.lower(F.trim(o)).startswith(F.concat(F.lit("("), letter, F.lit(")"))) & (letter != "")), F.lit(0)), answer)


def reworded(text: Column, table: dict[str, str]) -> Column:
    """Text looked up in a table of canonical wordings; itself where the table has none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), text), text) if table else text


def safe_level(text: Column) -> Column:
    """A number on a scale of 1 to 7 mapped to 0 to 1, null if it isn't one."""
    return (text.try_cast("double") - 1) / 6
