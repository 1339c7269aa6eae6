"""Personal data: values of fixed forms, and the words that give them away.

Values (mail and IP addresses, card and phone numbers) are found by pattern. Each value is an entity to protect.
How much a word t tells about an entity c is their pointwise mutual information over the documents, and
all there is to tell is the entity's information content: with n(t) documents that hold t and n(c, t) where it
stands next to c, they differ by log2(n(t) / n(c, t)) bits. A word that leaves ``SLACK`` bits or fewer is
generalised, one that leaves ``REMOVE`` bits or fewer removed, wherever it stands. Only words met next to
the entity in ``SUPPORT`` different surroundings count, so neither copies nor chance make a word tell. All of it
is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.common import kept

#: Patterns of the values, in the order of the kinds. They match what the plain forms do, without backtracking over long runs.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])(?:[A-Za-z0-9.-](?<!\.(?![A-Za-z0-9-])))++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: A character without which there is no such value.
NEEDS = {"email": "@", "phone": "+"}
#: Between words.
GAP = r"[^\p{L}\p{N}]+"
#: Words on each side of a value, and the code points within which they are looked for.
SIDE, REACH = 8, 200
SUPPORT = 3
SLACK, REMOVE = 1.0, 0.15
#: Words that are broadcast at most; more are joined by a shuffle.
BROADCAST = 50_000


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def running(x: Column, width: int = 128) -> Column:
    """For each number of an array the sum of those before it, chunk by chunk so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)
    inside = lambda a: F.transform(a, lambda _, i: total(F.slice(a, 1, i)))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda i: F.slice(x, i * width + 1, F.lit(width)))
    return let(cut, lambda c: let(F.transform(c, total), lambda s: F.flatten(F.zip_with(c, inside(s), lambda a, o: F.transform(inside(a), lambda v: v + o)))))


def words(x: Column) -> Column:
    """Words of three characters or more that begin with a letter, as they stand."""
    return F.filter(F.split(x, GAP), lambda w: (F.char_length(w) >= 3) & w.rlike(r"^\p{L}"))


def _beside(x: Column, last: bool) -> Column:
    """The words at one end of a stretch of text; one that is cut does not count."""
    part = F.split(F.right(x, F.lit(REACH)) if last else F.left(x, F.lit(REACH)), GAP)
    whole = F.when(F.char_length(x) <= REACH, part).when(F.lit(last), F.slice(part, 2, F.size(part))).otherwise(F.slice(part, 1, F.size(part) - 1))
    good = F.filter(whole, lambda w: (F.char_length(w) >= 3) & w.rlike(r"^\p{L}"))
    return F.reverse(F.slice(F.reverse(good), 1, SIDE)) if last else F.slice(good, 1, SIDE)


def located(text: Column, pattern: Column, found: Column, make: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``make(start, value, text before, text after)`` of each match of ``found``, the matches of ``pattern`` in ``text``."""

    def build(m: Column) -> Column:
        def of(p: Column) -> Column:
            long = F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: F.char_length(a) + F.char_length(b))
            return let(running(long), lambda at: F.transform(m, lambda v, i: make(at[i] + F.char_length(p[i]), v, p[i], p[i + 1])))

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), of))

    return let(found, build)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        least = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(least(p)) <= 3) & (F.coalesce(F.nullif(least(p), F.lit("")).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        at = lambda d, i: F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        luhn = lambda d: F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, double(at(d, i))).otherwise(at(d, i)))
        return let(digits, lambda d: F.length(d).between(12, 19) & (luhn(d) % 10 == 0))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def values(text: Column) -> Column:
    """Spans of all values by start and kind: ``start, no, stop, kind, value, near``; ``near`` are the words beside it."""
    every = []
    for no, (kind, pattern) in enumerate(KINDS):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if kind in NEEDS:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))

        def make(start: Column, value: Column, before: Column, after: Column, no=no, kind=kind) -> Column:
            near = F.when(_valid(kind, value), F.concat(_beside(before, True), _beside(after, False)))
            return F.struct(
                start.cast("bigint").alias("start"), F.lit(no).alias("no"), (start + F.char_length(value)).cast("bigint").alias("stop"),
                F.lit(kind).alias("kind"), value.alias("value"), near.alias("near"),
            )

        every.append(F.coalesce(F.filter(located(text, F.lit(pattern), found, make), lambda s: s["near"].isNotNull()), F.array().cast("array<struct<start:bigint,no:int,stop:bigint,kind:string,value:string,near:array<string>>>")))
    return F.array_sort(F.concat(*every))


def candidates(base: DataFrame, support: int = SUPPORT, slack: float = SLACK) -> DataFrame:
    """``(entity, word, together)``: words beside a value in ``support`` different surroundings, and the documents where they are.

    A word that stands beside so many other values that it leaves more than ``slack`` bits is left out at once. Entities
    are hashes of kind and lower-cased value. Counts are combined before each shuffle, so a value that a third of all
    documents hold is no hot group.
    """
    some = base.where(F.size("spans") > 0)
    entity = lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))
    each = some.select(F.explode("spans").alias("s")).select(entity(F.col("s")).alias("entity"), F.xxhash64("s.near").alias("place"), F.explode(F.array_distinct("s.near")).alias("word"))
    wide = each.groupBy("entity", "word").agg(F.count_distinct("place").alias("places")).where(F.col("places") >= support)
    tagged = lambda s: F.transform(s["near"], lambda w: F.concat(F.hex(entity(s)), F.lit(":"), w))
    pairs = some.select(F.explode(F.array_distinct(F.flatten(F.transform("spans", tagged)))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("together"))
    pairs = pairs.select(F.conv(F.substring_index("pair", ":", 1), 16, -10).cast("bigint").alias("entity"), F.substring_index("pair", ":", -1).alias("word"), "together")
    beside = some.select(F.explode(F.array_distinct(F.flatten("spans.near"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("beside"))
    met = wide.join(pairs, ["entity", "word"]).join(beside, "word")
    return met.where(F.log2(F.col("beside") / F.col("together")) <= slack).select("entity", "word", "together")


def telling(docs: DataFrame, pairs: DataFrame, text: str = "text", slack: float = SLACK, remove: float = REMOVE) -> DataFrame:
    """``(word, bits, action)``: words that leave at most ``slack`` bits of some entity; counted over all documents.

    Words are counted before they are joined, so the join has a row for each word, not for each of its documents.
    """
    counts = docs.select(F.explode(F.array_distinct(F.split(F.col(f"`{text}`"), GAP))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("everywhere"))
    left = counts.join(kept(pairs, "words-beside"), "word").groupBy("word").agg(F.min(F.log2(F.col("everywhere") / F.col("together"))).alias("bits"))
    return left.where(F.col("bits") <= slack).withColumn("action", F.when(F.col("bits") <= remove, "remove").otherwise("generalise"))


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def word_spans(docs: DataFrame, tell: DataFrame, text: str = "text") -> DataFrame:
    """``(k1, k2, words)`` for each different text that holds a telling word: its spans ``start, stop, value, action``."""
    own = F.col(f"`{text}`")
    src = docs.select(*text_key(own), own.alias("text"))
    each = src.select("k1", "k2", F.explode(F.array_distinct(F.split("text", GAP))).alias("word"))
    few = F.broadcast(tell) if tell.count() <= BROADCAST else tell
    hits = each.join(few, "word").groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(F.struct("word", "action"))).alias("acts"))
    held = src.join(hits, ["k1", "k2"]).withColumn("pattern", F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.map_keys("acts"), "|"), F.lit(r")(?![\p{L}\p{N}])")))

    def make(start: Column, value: Column, _: Column, __: Column) -> Column:
        return F.struct(start.cast("bigint").alias("start"), (start + F.char_length(value)).cast("bigint").alias("stop"), value.alias("value"), F.col("acts")[value].alias("action"))

    found = located(F.col("text"), F.col("pattern"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), make)
    return held.select("k1", "k2", found.alias("words")).dropDuplicates(["k1", "k2"])


def scan(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(ident, spans)`` for every row: spans ``start, stop, kind, value, action`` by start and kind.

    Values have the action ``replace``; the kind ``word`` marks words that give a value away, outside the values.
    Starts and stops are code points, stops exclusive. NULL and empty texts have no spans. Rows with a NULL or repeated id
    come back as they stand, equal texts have equal spans; other columns are left out; an empty table gives no rows.
    """
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    src = docs.select(F.col(f"`{ident}`").alias("_id"), own.alias("text"))
    base = kept(src.select("_id", *text_key(F.col("text")), values(F.col("text")).alias("spans")), "values")
    tell = kept(telling(src, candidates(base)), "telling")
    both = base.join(kept(word_spans(src, tell), "word-spans"), ["k1", "k2"], "left")
    value = lambda s: F.struct(s["start"], s["no"], s["stop"], s["kind"], s["value"], F.lit("replace").alias("action"))
    word = lambda s: F.struct(s["start"], F.lit(len(KINDS)).alias("no"), s["stop"], F.lit("word").alias("kind"), s["value"], s["action"])
    free = F.filter("words", lambda w: ~F.exists("spans", lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"])))
    every = F.transform("spans", value)
    every = F.when(F.col("words").isNull(), every).otherwise(F.array_sort(F.concat(every, F.transform(free, word))))
    return both.select(F.col("_id").alias(ident), F.transform(every, lambda s: F.struct(s["start"], s["stop"], s["kind"], s["value"], s["action"])).alias("spans"))


def cleaned(text: str | Column, spans: str | Column) -> Column:
    """The text with ``[KIND]`` for each value and generalised word and nothing for a removed word; spans that overlap become one."""
    text, spans = (F.col(x) if isinstance(x, str) else x for x in (text, spans))
    label = lambda s: F.when(s["action"] == "remove", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), label(s))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
