"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base: e-mail addresses, IP addresses, card and phone numbers by their own patterns, each kind leftmost first and not
overlapping. The patterns are written so that a text of any shape is read in linear time: runs are entered at their
left edge only (or where the last match ended) and never given back.

Bootstrapping: an instance is a token with a digit or ``@``, joined with the tokens with digits that follow it (a spaced
number is one instance), or a name of two capitalised words or more, without outer punctuation; each context it
stands in is a lexical pattern: the two words before it, or the word before with the word after. Instances with a base find
in them are seeds of score 1, and so are those that by their ``SHAPES`` can hardly be anything else (keys, social security and
account numbers), which are spans of kind ``id`` at once. In each of ``ROUNDS`` rounds a pattern's confidence is the mean score of its distinct instances
(one of score 0 added), if at least ``SUPPORT`` of them count as found; then an instance that is no seed scores
1 - product of (1 - confidence) over its patterns. Instances of ``SURE`` or more in a pattern of ``SURE`` or more
are new spans of kind ``id``, unless they overlap a base span.

Contexts are the words within ``REACH`` characters. The graph holds distinct pairs only and its sums combine before
the shuffle, so a context or an instance that is everywhere costs no more than its distinct neighbours.

Edge cases: a null text counts as empty; rows equal in id and text are read once and told alike; a null id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendspan.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?:(?<!\S)|\G)(?:[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@\p{L}]{0,2}[0-9][^\s@]*+)*+|\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)++)",
}
#: Of instances that are seeds by themselves: random keys, social security numbers, account numbers.
SHAPES = r"^(?:(?=(?:[^0-9]*+[0-9]){4})(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_+/=-]{24,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)$"
ROUNDS, SUPPORT, SURE, REACH, LEAST = 3, 3, 0.7, 64, 6
LAST = (1 << 63) - 1


def _found(kind: str, wanted: Column) -> Column:
    """(kind, i, found, gap, before, after) of each match: the characters since the last match, and what stands around."""
    pieces = F.transform(F.split(F.col("text"), PATTERNS[kind], -1), lambda p: F.struct(F.length(p).alias("gap"), *([F.right(p, F.lit(REACH)).alias("before"), F.left(p, F.lit(REACH)).alias("after")] if kind == "token" else [])))
    lists = [F.regexp_extract_all(F.col("text"), F.lit(PATTERNS[kind]), F.lit(0)).alias("m"), pieces.alias("p")]
    if kind == "token":
        lists.append(F.slice(pieces, F.lit(2), F.size(pieces)).alias("q"))
    none = F.lit(None).cast("string")
    rows = F.transform(F.arrays_zip(*lists), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["m"].alias("found"), z["p"]["gap"].alias("gap"), (z["p"]["before"] if kind == "token" else none).alias("before"), (z["q"]["after"] if kind == "token" else none).alias("after")))
    empty = F.array().cast("array<struct<kind:string,i:int,found:string,gap:int,before:string,after:string>>")
    return F.when(wanted, F.filter(rows, lambda r: r["found"].isNotNull())).otherwise(empty)


def _luhn(number: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: d.cast("int") * (i % 2 + 1) - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    digits = F.length(F.regexp_replace("found", "[^0-9]", ""))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(F.col("kind") == "ip", F.col("found").rlike(rf"^{part}\.{part}\.{part}\.{part}\z"))
        .when(F.col("kind") == "card", F.when(digits.between(13, 19), _luhn(F.col("found"))).otherwise(False))
        .when(F.col("kind") == "phone", digits.between(9, 15))
        .otherwise(True)
    )


def read(docs: DataFrame) -> DataFrame:
    """Base finds and tokens with their places: (_doc, _digest, kind, start, end, found, before, after), from docs with _doc and _digest."""
    digit = F.col("text").rlike("[0-9]")
    at = F.contains(F.col("text"), F.lit("@"))
    some = docs.filter(digit | at | F.col("text").rlike(r"\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}"))
    each = [_found(k, {"email": at, "token": F.lit(True)}.get(k, digit)) for k in PATTERNS]
    rows = written(some.select("_doc", "_digest", F.explode(F.concat(*each)).alias("r")).select("_doc", "_digest", "r.*").dropDuplicates(["_doc", "_digest", "kind", "i"]))
    here = Window.partitionBy("_doc", "_digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(here)).withColumn("start", F.col("end") - F.length("found"))
    return written(placed.filter(_valid()).select("_doc", "_digest", "kind", "start", "end", "found", "before", "after"))


def _shape(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


def instances(spans: DataFrame) -> DataFrame:
    """Tokens without outer punctuation: (_doc, _digest, start, end, token, seed, taken, shaped, patterns). ``seed``: a base span starts in it, or it is ``shaped`` like one; ``taken``: one overlaps it."""
    lead = F.length(F.regexp_extract("found", r"^[^\p{L}\p{N}+]*", 0))
    core = F.regexp_extract("found", r"^[^\p{L}\p{N}+]*+(.*?)[^\p{L}\p{N}]*$", 1)
    tokens = spans.filter("kind = 'token'").select("_doc", "_digest", (F.col("start") + lead).alias("start"), core.alias("token"), "before", "after")
    tokens = tokens.filter(F.length("token") > 0).withColumn("end", F.col("start") + F.length("token"))
    base = spans.filter("kind <> 'token'").select("_doc", "_digest", F.col("start").alias("s"), F.col("end").alias("e"))
    # tokens and base spans in one order of start: how far base spans before reach, and where the next one starts
    both = tokens.select("_doc", "_digest", "start", "end", "token", "before", "after", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e")).unionByName(base.select("_doc", "_digest", F.col("s").alias("start"), "s", "e"), allowMissingColumns=True)
    order = Window.partitionBy("_doc", "_digest").orderBy("start", F.col("token").isNotNull())
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # read backwards, since a frame that shrinks would be summed anew for each row
    back = Window.partitionBy("_doc", "_digest").orderBy(F.desc("start"), F.col("token").isNotNull().desc())
    following = F.last("s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    latest = F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = both.withColumn("reach", reach).withColumn("following", following).withColumn("latest", latest).filter("token IS NOT NULL")
    starts_in = F.coalesce((F.col("latest") == F.col("start")) | (F.col("following") < F.col("end")), F.lit(False))
    overlaps = F.coalesce((F.col("reach") > F.col("start")) | (F.col("following") < F.col("end")), F.lit(False))
    left = F.filter(F.split(F.col("before"), r"\s+"), lambda w: w != "")
    right = F.filter(F.split(F.col("after"), r"\s+"), lambda w: w != "")
    one, two = _shape(F.element_at("left", -1)), _shape(F.get("left", F.size("left") - 2))
    shaped = F.col("token").rlike(SHAPES) & ~overlaps
    told = marked.select("_doc", "_digest", "start", "end", "token", (starts_in | shaped).alias("seed"), overlaps.alias("taken"), shaped.alias("shaped"), left.alias("left"), right.alias("right"))
    told = told.withColumn("one", F.when(F.size("left") > 0, one)).withColumn("two", F.when(F.size("left") > 1, two)).withColumn("next", F.when(F.size("right") > 0, _shape(F.get("right", F.lit(0)))))
    patterns = F.array_compact(F.array(F.when(F.col("two").isNotNull(), F.xxhash64(F.lit("before"), "two", "one")), F.when(F.col("one").isNotNull() & F.col("next").isNotNull(), F.xxhash64(F.lit("around"), "one", "next"))))
    return told.filter(F.col("seed") | ~F.col("taken")).select("_doc", "_digest", "start", "end", "token", "seed", "taken", "shaped", patterns.alias("patterns"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE, least: int = LEAST) -> DataFrame:
    """New identifiers (_doc, _digest, start, end) among the instances found."""
    found = written(found.withColumn("instance", F.xxhash64("token")))
    pairs = written(found.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    seeds = pairs.groupBy("instance").agg(F.max("seed").alias("seed"))
    scores = written(seeds.select("instance", "seed", F.col("seed").cast("int").cast("double").alias("score")))
    patterns = None
    for _ in range(rounds):
        each = pairs.select("pattern", "instance").join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("total"), F.count("*").alias("n"), F.sum((F.col("score") >= sure).cast("long")).alias("met"))
        patterns = written(each.filter(F.col("met") >= support).select("pattern", (F.round(F.col("total"), 9) / (F.col("n") + 1)).alias("confidence")))
        doubt = pairs.join(patterns, "pattern").groupBy("instance").agg(F.sum(F.log(1 - F.col("confidence"))).alias("doubt"))
        scores = written(scores.select("instance", "seed").join(doubt, "instance", "left").select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("score")))
    good = patterns.filter(F.col("confidence") >= sure).select("pattern")
    likely = scores.filter(~F.col("seed") & (F.col("score") >= sure)).select("instance")
    new = found.filter(~F.col("taken") & (F.length("token") >= least)).join(likely, "instance", "left_semi")
    met = new.select("_doc", "_digest", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi").select("_doc", "_digest", "start", "end")
    return met.unionByName(found.filter("shaped").select("_doc", "_digest", "start", "end")).distinct()


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for every row of (doc_id, text): the spans (order, kind, start, end, base) in order."""
    keyed = docs.select(docs["doc_id"], docs["text"], F.coalesce(docs["doc_id"], F.lit(LAST)).alias("_doc"), F.xxhash64(docs["text"]).alias("_digest"))
    spans = read(keyed)
    base = spans.filter("kind <> 'token'").select("_doc", "_digest", "kind", "start", "end", F.lit(True).alias("base"))
    new = bootstrap(instances(spans)).select("_doc", "_digest", F.lit("id").alias("kind"), "start", "end", F.lit(False).alias("base"))
    number = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "id")]), F.col("kind"))
    all_spans = base.unionByName(new).groupBy("_doc", "_digest").agg(F.array_sort(F.collect_list(F.struct(number.alias("order"), "start", "end", "kind", "base"))).alias("found"))
    return keyed.select("doc_id", "_doc", "_digest").join(all_spans, ["_doc", "_digest"], "left").select("doc_id", F.coalesce("found", F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string,base:boolean>>")).alias("found"))


def op1_private(spark, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in (*KINDS, "id")], F.size("found").cast("long").alias("n_spans"), F.sha2(listed(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
