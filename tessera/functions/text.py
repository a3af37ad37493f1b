"""Text, number and date columns."""

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repaired(text: Column) -> Column:
    """The text that was meant where UTF-8 has been read as Latin-1; any other text as it is."""
    suspect = text.rlike("[\u00C2-\u00F4][\u0080-\u00BF]") & ~text.rlike("[^\u0000-\u00FF]")
    meant = F.try_validate_utf8(F.encode(F.when(suspect, text), "ISO-8859-1").cast("string"))
    return F.coalesce(meant, text)


def norm_string(text: Column) -> Column:
    """Repaired, without no-break spaces and without space at the ends."""
    return F.trim(F.translate(repaired(text), "\u00A0", " "))


def parse_number(text: Column) -> Column:
    """The first number of a text as a double: thousands separated by commas, a sign, decimals, an exponent; null without one."""
    found = F.regexp_extract(text, r"([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(found != "", F.regexp_replace(found, ",", "").try_cast("double"))


def number_unit(text: Column) -> Column:
    """The letters or sign right behind the first number, null without; endings of ordinals (1st, 2nd, 3rd, 4th) are no units."""
    unit = F.regexp_extract(text, r"[0-9](?:[0-9,.]*[0-9])?(?:[eE][+-]?[0-9]+)?\s*([\p{L}%°$€£]+)", 1)
    return F.when((unit != "") & ~F.lower(unit).isin("st", "nd", "rd", "th"), unit)


_DAY = T.StructType([T.StructField(n, T.IntegerType()) for n in ("year", "month", "day")])


@F.pandas_udf(_DAY)
def _fuzzy_date(texts: pd.Series) -> pd.DataFrame:
    from dateutil import parser

    defaults = datetime(1904, 2, 29), datetime(1996, 4, 12)  # two that share no part: a part read off the text is the same with both

    def one(value: str) -> tuple:
        try:
            a, b = (parser.parse(value, default=d, fuzzy=True) for d in defaults)
        except (ValueError, OverflowError, TypeError):
            return None, None, None
        return tuple(x if x == y else None for x, y in ((a.year, b.year), (a.month, b.month), (a.day, b.day)))

    parts = [one(t) if t else (None, None, None) for t in texts]
    return pd.DataFrame({n: pd.array([p[i] for p in parts], dtype="Int32") for i, n in enumerate(("year", "month", "day"))})


def fuzzy_date(text: Column) -> Column:
    """``struct<year, month, day>`` that a text says somewhere; parts it leaves out are null, all of them if it says none."""
    return F.when(text.rlike("[0-9]"), _fuzzy_date(text))


def has_only_year(date: Column) -> Column:
    return date["year"].isNotNull() & date["month"].isNull() & date["day"].isNull()


def first_day_of_year(date: Column) -> Column:
    return date["year"].isNotNull() & (date["month"] == 1) & (date["day"] == 1)


#: Parsers by name, for configurations to choose from.
DATE_PARSERS: dict[str, Callable[[Column], Column]] = {"basic": fuzzy_date}
NUMBER_PARSERS: dict[str, Callable[[Column], Column]] = {"basic": parse_number}


def register_parser(name: str, *, date: Callable[[Column], Column] | None = None, number: Callable[[Column], Column] | None = None) -> None:
    """Adds parsers under a name; one that is taken is an error."""
    for known, own in ((DATE_PARSERS, date), (NUMBER_PARSERS, number)):
        if own is not None:
            if name in known:
                raise ValueError(f"there is a parser {name} already")
            known[name] = own


def parsed(cells: DataFrame, dates: str = "basic", numbers: str = "basic") -> DataFrame:
    """``cells`` with ``normed, number, unit, date`` of ``value``; each distinct text is parsed once, by the parsers named. An unknown name is an error."""
    for known, name in ((DATE_PARSERS, dates), (NUMBER_PARSERS, numbers)):
        if name not in known:
            raise ValueError(f"there is no parser {name}; there are {sorted(known)}")
    texts = cells.select("value").distinct().withColumn("normed", norm_string(F.col("value")))
    found = texts.select(F.col("value").alias("text"), "normed", NUMBER_PARSERS[numbers](F.col("normed")).alias("number"), number_unit(F.col("normed")).alias("unit"), DATE_PARSERS[dates](F.col("normed")).alias("date"))
    return cells.join(found, F.col("value").eqNullSafe(F.col("text")), "left").drop("text")


def numeric_kind(cells: DataFrame, least: float = 0.95) -> DataFrame:
    """``table_id, col, kind``: ``integer`` if more than ``least`` of a column's filled cells are numbers and more than that of these are whole, ``float`` if
    only the former, else null. Empty cells and those that say na or n/a do not count."""
    plain = F.lower(F.trim("value"))
    number = F.regexp_replace(plain, ",", "").try_cast("double")
    filled = cells.where(~plain.isin("", "na", "n/a")).select("table_id", "col", number.alias("number"))
    shares = filled.groupBy("table_id", "col").agg(F.avg(F.col("number").isNotNull().cast("int")).alias("numeric"), F.avg(F.when(F.col("number").isNotNull(), (F.col("number") == F.floor("number")).cast("int"))).alias("whole"))
    return shares.select("table_id", "col", F.when((F.col("numeric") > least) & (F.col("whole") > least), "integer").when(F.col("numeric") > least, "float").alias("kind"))


def at_least(count: Column, steps: tuple[int, ...] = (5, 10, 15, 20, 30, 40, 50)) -> Column:
    """``struct<gte5, gte10, ...>``: which of the steps a count reaches."""
    return F.struct(*[(count >= n).alias(f"gte{n}") for n in steps])


def span_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def statement_parts(node: Column) -> Column:
    """``struct<entity_id, prop, stmt_idx>`` of a statement's name in the data graph."""
    part = F.split(node, r"\|")
    return F.struct(part[0].alias("entity_id"), part[1].alias("prop"), part[2].try_cast("int").alias("stmt_idx"))


def time_parts(value: Column) -> Column:
    """``struct<year, month, day, hour, minute, second>`` of a time text like +1967-01-17T00:00:00Z; parts that are 0 are null."""
    pattern = r"^([+-]?[0-9]+)-([0-9]{1,2})-([0-9]{1,2})T([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})Z?$"
    names = ["year", "month", "day", "hour", "minute", "second"]
    return F.struct(*[F.nullif(F.regexp_extract(value, pattern, i + 1).try_cast("int"), F.lit(0)).alias(n) for i, n in enumerate(names)])


def similarity(a: Column, b: Column) -> Column:
    """1.0 for equal texts, 0.95 for one edit at most, 0.85 if the edits are under 3% of the shorter text, else null (no match)."""
    edits = F.levenshtein(a, b)
    shorter = F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))
    return F.when(a == b, F.lit(1.0)).when(edits <= 1, F.lit(0.95)).when(edits / shorter < 0.03, F.lit(0.85))


def covered_fraction(span_lengths: Column, text: Column) -> Column:
    """The part of a cell that its links cover."""
    return F.aggregate(span_lengths, F.lit(0), lambda a, x: a + x) / F.greatest(F.lit(1), F.length(text))


def label(name: Column, identifier: Column) -> Column:
    """``name (id)``, or the id where there is no name."""
    return F.coalesce(F.concat(name, F.lit(" ("), identifier, F.lit(")")), identifier)


def column_uri(index: Column) -> Column:
    return F.concat(F.lit("http://example.com/table/"), index.cast("string"))


def column_of_uri(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^http://example\.com/table/([0-9]+)$", 1).try_cast("int")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of two texts split at single spaces."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _closeness(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two tokens."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, shared = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                shared.append(x)
                break
    if not shared:
        return 0.0
    swapped = sum(x != y for x, y in zip(shared, (y for y, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    m = len(shared)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return jaro + min(4, start) * 0.1 * (1 - jaro)


def _best_assignment(scores: list[list[float]]) -> list[float]:
    """Scores of the pairing of rows with columns that has the highest sum; there are at most as many rows as columns."""
    n, m = len(scores), len(scores[0])
    row_price, col_price, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j, least, came, done = i, 0, [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[j]:
            done[j], best, then = True, float("inf"), 0
            for k in range(1, m + 1):
                if not done[k]:
                    cost = -scores[owner[j] - 1][k - 1] - row_price[owner[j]] - col_price[k]
                    if cost < least[k]:
                        least[k], came[k] = cost, j
                    if least[k] < best:
                        best, then = least[k], k
            for k in range(m + 1):
                if done[k]:
                    row_price[owner[k]] += best
                    col_price[k] -= best
                else:
                    least[k] -= best
            j = then
        while j:
            owner[j], j = owner[came[j]], came[j]
    return [scores[owner[k] - 1][k - 1] for k in range(1, m + 1) if owner[k]]


def soft_jaccard_of(a: str, b: str, threshold: float = 0.5) -> float:
    """Jaccard similarity of two texts' tokens (split at single spaces) where tokens may match in part, each with one other at most, from ``threshold`` on."""
    small, large = sorted((sorted(set(a.split(" "))), sorted(set(b.split(" ")))), key=len)
    scores = [[s if (s := _closeness(x, y)) >= threshold else 0.0 for y in large] for x in small]
    matched = [s for s in _best_assignment(scores) if s > 0]
    return sum(matched) / (len(small) + len(large) - len(matched)) if matched else 0.0


@F.pandas_udf(T.DoubleType())
def soft_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else soft_jaccard_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def friendly_id(url: Column) -> Column:
    """A name that is safe in a file system: the slug of the url's path, ``_``, and the md5 of the url. Only pages with slugs of their own (the
    encyclopedias' hosts) have such a name; any other url is an error."""
    host = F.parse_url(url, F.lit("HOST"))
    url = F.when(host.rlike(r"(?:^|\.)(?:wikipedia|dbpedia)\.org$"), url).otherwise(F.raise_error(F.concat(F.lit("no friendly name for "), url)))
    return slug_id(url)


def slug_id(url: Column) -> Column:
    """``friendly_id`` for urls of any host."""
    path = F.parse_url(url, F.lit("PATH"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(slug, F.lit("_"), F.md5(url))
