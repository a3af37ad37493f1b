"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss. SQL functions only on the executors.

Base spans are the leftmost, non-overlapping matches of four patterns that pass their checks. They are the seeds: the words around them
make lexical patterns (the two words before; the word before and the word after), and all identifier-like tokens of the
corpus are the instances of the patterns they stand in. Scores go back and forth over that graph for a fixed number of rounds: a
pattern's confidence in a kind is the share of its distinct instances that are of that kind so far, an instance's score is the noisy-or of
its patterns. Tokens in patterns with enough support and confidence are added as spans of that kind.

The scores are grouped sums over (pattern, instance) pairs made distinct first, so a pattern or identifier that stands in a third of all
rows is summed in parts. Places are code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows are alike, whatever their ids; a null id stays null; an
empty table gives no rows; other columns are ignored, and ``redact`` returns them untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import _stage

KINDS = ("email", "ip", "card", "phone")
#: Characters of a text that are redacted at once.
PIECE = 1 << 14
#: The patterns, written so that no match is tried twice: possessive where nothing after could give back, and begun only where a
#: run begins or the last match ended. They match what the plain forms in the comments match.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # identifier-like tokens: a digit or an at sign within letters, digits and +@._%/-
    "token": r"(?:\G|(?<![A-Za-z0-9+@._%/-]))(?=[A-Za-z+._%/-]*+[0-9@])[A-Za-z0-9+](?:[A-Za-z0-9+@._%/-]*[A-Za-z0-9])?",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "contains(text, '@')", "ip": "has_digit", "card": "has_digit", "phone": "contains(text, '+')", "token": "has_digit or contains(text, '@')"}
#: Of the text around a match, what its patterns need, whole words however long: up to two words before it, read from a reversed text, and one after.
BEFORE = r"^\s*+(?:\S++\s++)?\S*+"
AFTER = r"^\s*+\S*+"
ROUNDS = 3
LEAST_SUPPORT = 5
LEAST_CONFIDENCE = 0.8
#: A token must have this many digits, or an at sign, to be an instance.
LEAST_DIGITS = 4


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: str) -> str:
    """SQL of an array with every match: the gap before it, its length, itself, and its context."""
    pattern = _quoted(PATTERNS[kind])
    found = f"named_struct('m', regexp_extract_all(text, {pattern}, 0), 'gaps', split(text, {pattern}, -1))"
    before, after = f"reverse(regexp_extract(reverse(z.gaps[i]), {_quoted(BEFORE)}, 0))", f"regexp_extract(z.gaps[i + 1], {_quoted(AFTER)}, 0)"
    one = f"named_struct('kind', '{kind}', 'at', i, 'gap', char_length(z.gaps[i]), 'len', char_length(x), 'm', x, 'before', {before}, 'after', {after})"
    empty = "cast(array() as array<struct<kind:string,at:int,gap:int,len:int,m:string,before:string,after:string>>)"
    return f"if({NEEDS[kind]}, transform(array({found}), z -> transform(z.m, (x, i) -> {one}))[0], {empty})"


def _valid() -> Column:
    """Whether a base match passes the check of its kind."""
    digits = F.regexp_replace("m", "[^0-9]", "")
    part = "0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.col("m").rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(F.col("kind") == "card", F.length(digits).between(12, 19) & F.expr("luhn_check(substring(regexp_replace(m, '[^0-9]', ''), 1, 19))"))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15))
        .otherwise(False)
    )


def found_spans(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``row, doc_id, kind, start, end, m, before, after, base``: base spans, tokens that overlap none, and one row of null kind for every document.

    ``row`` names a column of ``docs`` that tells rows apart; without it they are numbered.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    texts = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("has_digit", F.col("text").rlike("[0-9]"))
    every = F.expr(f"concat(array(cast(null as struct<kind:string,at:int,gap:int,len:int,m:string,before:string,after:string>)), {', '.join(_matches(k) for k in PATTERNS)})")
    rows = _stage.written(texts.select("row", "doc_id", F.explode(every).alias("x")).select("row", "doc_id", "x.*"), "matches")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    placed = placed.withColumn("base", F.coalesce(_valid(), F.lit(False)))
    usable = (F.length(F.regexp_replace("m", "[^0-9]", "")) >= LEAST_DIGITS) | F.col("m").contains("@")
    placed = placed.where(F.col("kind").isNull() | F.col("base") | ((F.col("kind") == "token") & usable))
    # a token overlaps a base span if one that begins no later ends after its start, or the next one begins before its end
    order = Window.partitionBy("row").orderBy("start")
    past = F.max(F.when(F.col("base"), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # seen from the end, so that it runs along as ``past`` does: a frame that ends with the partition is made anew for every row
    backward = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.min(F.when(F.col("base"), F.col("start"))).over(backward)
    free = F.coalesce(past <= F.col("start"), F.lit(True)) & F.coalesce(following >= F.col("end"), F.lit(True))
    marked = placed.withColumn("free", free)
    return _stage.written(marked.where(F.col("kind").isNull() | F.col("base") | F.col("free")).drop("free", "at", "gap", "len"), "spans")


def _patterns() -> Column:
    """The lexical patterns of a match: words before and after, lower-cased, digits as 0."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    before, after = plain(F.col("before")), plain(F.col("after"))
    two = F.regexp_extract(before, r"^\s*+(\S++\s++\S++)\s*+$", 1)
    last = F.regexp_extract(before, r"^\s*+(?:\S++\s++)?(\S++)\s*+$", 1)
    following = F.regexp_extract(after, r"^\s*+(\S++)", 1)
    both = F.when((last != "") & (following != ""), F.concat(last, F.lit(" _ "), following))
    return F.array_compact(F.array(F.when(two != "", F.concat(F.regexp_replace(two, r"\s+", " "), F.lit(" _"))), both))


def learned_patterns(spans: DataFrame, rounds: int = ROUNDS, support: int = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """``pattern, kind, confidence``: the patterns that name a kind, after ``rounds`` rounds over the pattern-instance graph."""
    edges = spans.where("kind is not null").select(F.explode(_patterns()).alias("pattern"), F.when(F.col("base"), F.col("kind")).alias("seed"), F.xxhash64(F.lower("m")).alias("instance"))
    edges = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    wide = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    edges = _stage.written(edges.join(wide, "pattern"), "graph")
    seeds = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores = _stage.written(seeds, "scores")
    for r in range(rounds):
        joined = edges.select("pattern", "instance", "n").join(scores, "instance")
        named = joined.groupBy("pattern", "kind", "n").agg(F.sum("score").alias("sum"), F.count("*").alias("known"))
        named = named.where(F.col("known") >= support).select("pattern", "kind", (F.col("sum") / F.col("n")).alias("confidence"))
        patterns = _stage.written(named, "patterns")
        if r < rounds - 1:
            missed = edges.where("seed is null").select("pattern", "instance").join(patterns, "pattern")
            other = missed.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
            scores = _stage.written(seeds.unionByName(other), "scores")
    best = Window.partitionBy("pattern").orderBy(F.col("confidence").desc(), "kind")
    return patterns.where(F.col("confidence") >= confidence).withColumn("nr", F.row_number().over(best)).where("nr = 1").select("pattern", "kind", "confidence")


def extract(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Per document ``row, doc_id, spans`` with ``spans array<struct<start, nr, end, kind, base>>`` in order of start, then kind as listed."""
    spans = found_spans(docs, row)
    patterns = learned_patterns(spans)
    tokens = spans.where("kind = 'token'").select("row", "start", "end", F.explode(_patterns()).alias("pattern"))
    named = tokens.join(patterns, "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    added = named.select("row", "start", "end", F.col("best.kind").alias("kind"), F.lit(False).alias("base"))
    base = spans.where("kind is null or base")
    every = base.select("row", "doc_id", "kind", "start", "end", "base").unionByName(added, allowMissingColumns=True)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.when(F.col("kind").isNotNull(), F.struct("start", rank.cast("int").alias("nr"), "end", "kind", "base"))
    return every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(one)).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` replaced by its kind; where spans overlap, the first and what it covers.

    Texts without a digit or an at sign can have no span and pass by; only the others are written, numbered and joined with their spans.
    """
    may = F.coalesce(F.col("text").cast("string").rlike("[0-9@]"), F.lit(False))
    numbered = docs.where(may).select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("nr"))
    numbered = _stage.written(numbered, "texts")
    found = extract(numbered.select("nr", F.col("own.doc_id").alias("doc_id"), F.col("own.text").alias("text")), "nr").where(F.size("spans") > 0).select(F.col("row").alias("nr"), "spans")
    joined = numbered.join(_stage.written(found, "found"), "nr", "left")
    text = F.col("own.text")
    # a place is found by counting from the beginning, so long texts are cut into pieces first; a span's kind stands where it begins
    size = F.lit(PIECE)
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / PIECE).cast("int")), lambda i: F.struct((i * size).alias("low"), F.substring(text, i * size + 1, size).alias("piece")))

    def redacted(x: Column) -> Column:
        between = lambda a, b: F.substring(x["piece"], (a - x["low"] + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
        own = F.filter("spans", lambda s: (s["end"] > x["low"]) & (s["start"] < x["low"] + size))
        return F.aggregate(
            own,
            F.struct(x["low"].cast("long").alias("at"), F.lit("").alias("out")),
            lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], between(a["at"], s["start"]), F.format_string(mark.replace("{}", "%s"), s["kind"])).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
            lambda a: F.when(a["at"] < x["low"] + size, F.concat(a["out"], between(a["at"], x["low"] + size))).otherwise(a["out"]),
        )

    pieces = F.array_join(F.transform(cut, redacted), "")
    clean = F.when(F.col("spans").isNull(), text).otherwise(pieces)
    changed = joined.select(*[clean.alias(c) if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns])
    return docs.where(~may).unionByName(changed)
