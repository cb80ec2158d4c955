"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Punctuation is dropped and words are cut at whitespace. A word is read in two ways. Typed: numbers, units and
capitalised names become ``<num>``, ``<unit>`` and ``<name>``, other words are lower-cased. Plain: names are lower-cased
too, so that a passage is known again whatever its capitals. What stands in the placeholders are the slots.

Each window of ``window`` words of a benchmark item (the whole item, if shorter) is a template; one that has fewer than
``literals`` words that are no placeholder is lengthened until it has. Where names would be such words in the plain
reading and it is reached in fewer words, that window is a template of the plain reading too. An item that has too few even
in the plain reading is one template as a whole, and only found word by word. The longest of these words is its anchor. Documents'
words are hash-joined with the anchors; where one stands, and the window's second longest word too, the document's
window is canonicalised and hash-joined with the template. At last the slots must be consistent: two slots of the window hold the same value in
the document just when they do in the benchmark. That finds a question again with other numbers, names and units.

The benchmark is broadcast if it has at most ``MOST_TEMPLATES`` templates (most hold ``window`` words, the others up to an item),
otherwise joined by shuffle.

Edge cases: a null or blank text matches nothing; items that are null or without words can't be found;
an item of one common word is found wherever that word stands; one in a script without spaces only between spaces;
repeated rows are judged each; repeated items are one item if their ids are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendspan.llm.common import table, written

WINDOW, LITERALS = 8, 5
MOST_TEMPLATES = 200_000

PUNCTUATION = r"[!-/:-@\[-`{-~¡-¿‐-‧‰-⁞]+"
SPACE = r"[\x20\x09-\x0D]+"

# Unit words that are read as <unit>.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "foot", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "celsius", "fahrenheit", "watt", "watts", "volt", "volts")
# Number words that are read as <num>.
NUMBERS = ("zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million")

_NUMBER = rf"^(?:[0-9]\w*|(?i:{'|'.join(NUMBERS)}))$"
_UNIT = rf"^(?i:{'|'.join(UNITS)})$"
_NAME = r"^\p{Lu}\p{Ll}"


#: What a window of a document must agree with before it is canonicalised.
KEY = ("n", "anchor", "offset", "second", "second_offset")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, PUNCTUATION, ""), SPACE), lambda w: w != "")


def typed(word: Column) -> Column:
    return F.when(word.rlike(_NUMBER), "<num>").when(word.rlike(_UNIT), "<unit>").when(word.rlike(_NAME), "<name>").otherwise(F.lower(word))


def plain(word: Column) -> Column:
    return F.when(word.rlike(_NUMBER), "<num>").when(word.rlike(_UNIT), "<unit>").otherwise(F.lower(word))


def pattern(words: Column, reading) -> Column:
    """For each slot of a window in turn, the place of the first slot with its value."""
    slots = F.transform(F.filter(words, lambda w: reading(w).startswith("<")), F.lower)
    return F.transform(slots, lambda s: F.array_position(slots, s))


def readings(words: Column) -> Column:
    """The hash of a window's template and the pattern of its slots, typed and plain."""
    return F.array(*[F.struct(F.lit(name).alias("reading"), F.xxhash64(F.array_join(F.transform(words, how), " ")).alias("template"), pattern(words, how).alias("slots")) for name, how in (("typed", typed), ("plain", plain))])


def templates(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(item_id, place, whole, *KEY, words, reading, template, slots) from (item_id, text); ``whole`` ones are matched word by word."""
    items = benchmark.select(benchmark["item_id"], words_of(benchmark["text"]).alias("all")).filter("size(all) > 0")
    read = items.select("item_id", "all", F.transform("all", lambda w: typed(w).startswith("<")).alias("in_typed"), F.transform("all", lambda w: plain(w).startswith("<")).alias("in_plain"))
    few = F.size(F.filter("in_plain", lambda x: ~x)) < literals
    places = F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - window)))
    placed = read.select("*", few.alias("whole"), F.explode(places).alias("place"))
    left = F.size("all") - F.col("place")

    def reach(slots: str) -> Column:
        """How many words from the place hold enough literals, a window at least; null if the item has no more of them."""
        last = F.get(F.filter(F.sequence(F.col("place"), F.size("all") - 1), lambda i: ~F.get(F.col(slots), i)), F.lit(literals - 1))
        return F.when(last.isNotNull(), F.greatest(last - F.col("place") + 1, F.least(F.lit(window), left)))

    sized = placed.withColumn("n_typed", reach("in_typed")).withColumn("n_plain", reach("in_plain"))
    form = lambda n, slots, both: F.struct(n.alias("n"), slots.alias("slot"), F.lit(both).alias("both"))
    by_typed = F.when(F.col("n_typed").isNotNull(), form(F.col("n_typed"), F.col("in_typed"), True))
    by_plain = F.when(F.col("n_typed").isNull() | (F.col("n_plain") < F.col("n_typed")), F.when(F.col("n_plain").isNotNull(), form(F.col("n_plain"), F.col("in_plain"), False)))
    by_word = form(F.size("all"), F.transform("all", lambda w: F.lit(False)), False)
    forms = F.when(F.col("whole"), F.array(by_word)).otherwise(F.filter(F.array(by_typed, by_plain), lambda x: x.isNotNull()))
    cut = sized.select("item_id", "place", "all", "whole", F.explode(forms).alias("f")).select("item_id", "place", "whole", "f.*", F.slice("all", F.col("place") + 1, F.col("f.n")).alias("words"))
    literal = F.filter(F.transform("words", lambda w, i: F.struct(F.when(F.get("slot", F.col("place") + i), 0).otherwise(F.length(w)).alias("size"), (-i).alias("before"), F.lower(w).alias("word"))), lambda x: x["size"] > 0)
    chosen = cut.withColumn("literal", F.sort_array(literal, asc=False)).withColumn("top", F.col("literal")[0]).withColumn("next", F.coalesce(F.get("literal", F.lit(1)), F.col("literal")[0]))
    at = lambda c: (-F.col(f"{c}.before")).alias
    known = chosen.select("item_id", "place", "whole", "both", "n", F.col("top.word").alias("anchor"), at("top")("offset"), F.col("next.word").alias("second"), at("next")("second_offset"), "words", F.explode(readings(F.col("words"))).alias("r"))
    known = known.filter(F.col("both") | (F.col("r.reading") == "plain"))
    return known.select("item_id", "place", "whole", *KEY, "words", "r.*").dropDuplicates(["item_id", "place", "reading", "template"])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(doc_id, start, item_id, place, exact): windows of documents that match templates; exact if the slots' values are those of the item."""
    known = written(templates(benchmark, window, literals))
    anchors = known.select(*KEY).distinct()
    if known.count() <= MOST_TEMPLATES:
        anchors, known = F.broadcast(anchors), F.broadcast(known)
    split = docs.select(docs["doc_id"], F.split(F.regexp_replace(docs["text"], PUNCTUATION, ""), SPACE).alias("all"))
    words = split.select("doc_id", "all", F.posexplode("all").alias("at", "word"))
    begin = F.col("at") - F.col("offset")
    there = F.lower(F.get("all", begin + F.col("second_offset"))) == F.col("second")
    hits = words.join(anchors, (F.lower("word") == F.col("anchor")) & (begin >= 0) & (begin + F.col("n") <= F.size("all")) & there)
    around = hits.select("doc_id", begin.alias("start"), *KEY, F.slice("all", begin + 1, F.col("n")).alias("found"))
    read = around.select("doc_id", "start", *KEY, "found", F.explode(readings(F.col("found"))).alias("r")).select("doc_id", "start", *KEY, "found", "r.reading", "r.template", F.col("r.slots").alias("found_slots"))
    joined = read.join(known, [*KEY, "reading", "template"])
    same = joined.filter(F.col("found_slots") == F.col("slots"))
    low = lambda c: F.lower(F.array_join(c, " "))
    told = same.select("doc_id", "start", "item_id", "place", "whole", (low("found") == low("words")).alias("exact"))
    return told.filter(~F.col("whole") | F.col("exact")).drop("whole")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(doc_id, contaminated, n_windows, items, changed_items) for every row: matched windows, item ids, and those whose slots hold other values."""
    found = matches(docs, benchmark, window, literals)
    per_item = found.groupBy("doc_id", "item_id").agg(F.count_distinct("start").alias("n"), F.max("exact").alias("exact"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    per_doc = per_item.groupBy("doc_id").agg(F.sum("n").alias("n"), listed(F.col("item_id")).alias("items"), listed(F.when(~F.col("exact"), F.col("item_id"))).alias("changed"))
    every = docs.select(docs["doc_id"].alias("id"))
    joined = every.join(per_doc, every["id"].eqNullSafe(per_doc["doc_id"]), "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("changed", F.lit("")).alias("changed_items"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
