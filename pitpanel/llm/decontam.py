"""Benchmark decontamination by templates, with built-in functions only.

Numbers, units and names become typed placeholders, so a question with other numbers or names has the same template. Blocks of
``BLOCK`` template words and of ``RAW_BLOCK`` words as they are, each cut one after the other from each document, are joined by hash with the windows at
every offset of the benchmark items; a shared run of twice a block less one always holds such a block. Each hit is then extended along its
diagonal: a document is contaminated where any ``RUN`` or more template words in a row agree with the slots filled consistently, or equal the item
word by word. An item shorter than that is searched for whole and word by word, at every offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import drop, store

BLOCK, RAW_BLOCK, RUN = 6, 7, 13
#: Hundredths of a run that must be literal rather than placeholders, unless it equals the item word by word.
LITERAL_PERCENT = 50
#: Windows of the benchmark up to which they are broadcast; a larger benchmark is joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: In a join by shuffle, windows of one hash are dealt to tasks by so many.
WINDOWS_A_TASK = 1_000
#: Hits of a document are aligned in so many parts at most, each of which reads the document's words once.
HIT_PARTS = 16

# Placeholders (private code points), and units that can follow a number.
NAME, NUMBER, UNIT = "\uE001", "\uE002", "\uE003"
UNITS = ["%", "am", "pm", "mm", "cm", "dm", "m", "km", "in", "ft", "yd", "mi", "miles?", "inch(?:es)?", "feet", "met(?:er|re)s?", "mg", "g", "kg", "t", "lbs?", "oz",
         "pounds?", "grams?", "ml", "cl", "l", "lit(?:er|re)s?", "gallons?", "ms", "s", "sec", "min", "h", "seconds?", "minutes?", "hours?", "days?", "weeks?", "months?", "years?",
         "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "a", "j", "kj", "n", "pa", "kb", "mb", "gb", "tb", "usd", "eur", "gbp", "dollars?", "euros?", "cents?", "kmh", "mph"]

_SPACE = r"[\s\p{Z}&&[^ ]][\s\p{Z}]*| [\s\p{Z}]+"
_NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;] .)\p{L}*"
_UNIT = r"(\d) ?(" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
_NUMBER = r"\d+(?:[.,:/]\d+)*"
_GAPS = r"[^\p{L}\p{N}" + NAME + "-" + UNIT + r".,:/]+|[.,:/]+(?!\d)|(?<!\d)[.,:/]+"


def tokens(text: Column, values: bool) -> Column:
    """Template words of a text, lower-cased. With ``values`` each placeholder is followed by what it stands for."""
    own = "$0" if values else ""
    folded = F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")
    named = F.lower(F.regexp_replace(folded, _NAME, f" {NAME}{own} "))
    with_units = F.regexp_replace(named, _UNIT, f"$1 {UNIT}{'$2' if values else ''} ")
    counted = F.regexp_replace(with_units, _NUMBER, f" {NUMBER}{own} ")
    return F.filter(F.split(counted, _GAPS), lambda w: w != "")


def _template(word: Column) -> Column:
    return F.when(_is_slot(word), F.left(word, F.lit(1))).otherwise(word)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(words: Column, n: Column | int, step: int, kind: str) -> Column:
    """(at, hash) of the spans of n words, each ``step`` words after the last."""
    n = n if isinstance(n, Column) else F.lit(n)
    last = F.floor((F.size(words) - n) / step).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("at"), F.xxhash64(F.lit(kind), F.slice(words, i * step + 1, n)).alias("hash")))
    return F.when(F.size(words) >= n, spans).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))


def _keys(text: Column, lengths: list[int]) -> Column:
    """What of a text is looked up: its blocks one after the other, and for items of these lengths every span."""
    def bare(words: Column) -> Column:
        return F.concat(_spans(words, RAW_BLOCK, RAW_BLOCK, "w"), *(_spans(words, n, 1, "w") for n in lengths))
    return _let(tokens(text, True), lambda words: F.concat(_let(F.transform(words, _template), lambda t: _spans(t, BLOCK, BLOCK, "t")), _let(F.transform(words, _bare), bare)))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(text), True).alias("item")).filter(F.size("item") > 0)
    keyed = items.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "item").alias("key"), "*")  # an id can be NULL or stand on several texts
    return keyed.withColumn("item_template", F.transform("item", _template)).withColumn("item_bare", F.transform("item", _bare)).withColumn("earlier", _earlier(F.col("item")))


def _windows(items: DataFrame) -> DataFrame:
    """(hash, key, n, at) of every window of the items; n is the length of the item."""
    n = F.size("item")
    spans = F.when(n >= RUN, F.concat(_spans(F.col("item_template"), BLOCK, 1, "t"), _spans(F.col("item_bare"), RAW_BLOCK, 1, "w"))).otherwise(_spans(F.col("item_bare"), n, 1, "w"))
    return items.select("key", n.alias("n"), F.inline(spans)).select("hash", "key", "n", "at")


def _met(blocks: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """Blocks beside the windows that have their hash. Where that takes a shuffle, frequent hashes are salted."""
    if small:
        return blocks.join(F.broadcast(windows), "hash")
    often = windows.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / WINDOWS_A_TASK).alias("salts")).filter("salts > 1")
    salts = F.coalesce("salts", F.lit(1))
    dealt = windows.join(often, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("key", "at"), salts)).drop("salts")
    return blocks.join(often, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts").join(dealt, ["hash", "salt"])


#: The longest stretch (run, end) of an aligned pair that counts, in one pass over ``marks``. ``cut`` starts the present piece of the agreeing run, which
#: is cut where a slot first becomes inconsistent, ``left`` the longest consistent stretch up to here, and ``equal`` counts words equal to the item's.
#: If no piece counts, stretches of RUN to 2 RUN - 1 words are tried at every offset; one of them counts wherever any stretch does.
_BEST = f"""aggregate(sequence(0, size(marks) - 1), named_struct('left', 0, 'cut', 0, 'literal', 0, 'equal', 0, 'run', 0, 'end', 0),
  (a, i) -> transform(transform(array(marks[i]), m -> named_struct(
      'left', if(m.same, greatest(a.left, m.clash + 1), i + 1),
      'cut', if(m.same, if(m.clash >= a.cut, i, a.cut), i + 1),
      'literal', if(m.same, if(m.clash >= a.cut, 0, a.literal) + m.literal, 0),
      'equal', if(m.equal, a.equal + 1, 0))), s -> transform(array(greatest(
        if(i + 1 - s.cut >= {RUN} and 100 * s.literal >= {LITERAL_PERCENT} * (i + 1 - s.cut), i + 1 - s.cut, 0),
        if(s.equal >= least({RUN}, size(marks)), s.equal, 0),
        if(a.run = 0 and i + 1 - s.left >= {RUN}, coalesce(array_max(filter(sequence({RUN}, least({2 * RUN - 1}, i + 1 - s.left)),
          n -> 100 * aggregate(slice(marks, i + 2 - n, n), 0, (c, x) -> c + x.literal) >= {LITERAL_PERCENT} * n)), 0), 0))),
      r -> named_struct('left', s.left, 'cut', s.cut, 'literal', s.literal, 'equal', s.equal,
                        'run', greatest(a.run, r), 'end', if(r > a.run, i + 1, a.end)))[0])[0])"""


def _bare(word: Column) -> Column:
    """A word without the placeholder before it."""
    return F.when(_is_slot(word), F.substring(word, 2, 1 << 30)).otherwise(word)


def _is_slot(word: Column) -> Column:
    return word.startswith(NAME) | word.startswith(NUMBER) | word.startswith(UNIT)


def _earlier(words: Column) -> Column:
    """For each word where the same word stands last before it, or -1."""
    at = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    pairs = _let(at, lambda s: F.transform(s, lambda x, k: F.struct(
        x["i"].alias("i"), F.when(F.get(s, k - 1)["w"] == x["w"], F.get(s, k - 1)["i"]).otherwise(-1).alias("earlier"))))
    return F.transform(F.array_sort(pairs), lambda x: x["earlier"])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, list[str]]:
    """One row for each document and item that share a run: doc_id, text_hash, item_id, run, slots, changed_slots. And scratch paths.

    ``run`` counts template words. Where slots are filled inconsistently (one value of the item by two of the document) the run is cut, and
    any stretch of ``RUN`` or more consistent words counts. NULL texts share nothing; items below ``RUN`` words count where all their words stand
    in a row, however few. Rows that repeat give one row; other columns are not looked at.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).filter("text is not null")
    items, p_items = store(_items(benchmark.filter(F.col(item_text).isNotNull()), item_id, item_text).distinct(), "bench-items")
    windows, p_windows = store(_windows(items), "bench-windows")
    small = windows.count() <= BROADCAST_WINDOWS
    lengths = sorted(r["n"] for r in windows.filter(F.col("n") < RUN).select("n").distinct().collect())
    blocks = keyed.select("doc_id", "text_hash", F.inline(_keys(F.col("text"), lengths))).withColumnRenamed("at", "block")
    met = _met(blocks, windows, small).select("doc_id", "text_hash", "key", "n", (F.col("block") - F.col("at")).alias("shift"))
    one = F.when(F.col("n") >= RUN, F.col("shift")).alias("own")  # a short item need be seen once
    hits, p_hits = store(met.groupBy("doc_id", "text_hash", "key", "n", one).agg(F.min("shift").alias("shift")).drop("own"), "bench-hits")
    own = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.pmod(F.xxhash64("key", "shift"), F.lit(HIT_PARTS))).agg(
        F.collect_list(F.struct("key", "n", "shift")).alias("hits")).select("d", "h", "hits")
    words = keyed.join(own, keyed.doc_id.eqNullSafe(own.d) & (keyed.text_hash == own.h)).select("doc_id", "text_hash", tokens(F.col("text"), True).alias("words"), "hits")
    beside = F.transform(F.sequence(F.lit(0), F.col("x.n") - 1), lambda i: F.get(F.col("words"), i + F.col("x.shift")))
    pairs = words.select("doc_id", "text_hash", "words", F.explode("hits").alias("x")).select("doc_id", "text_hash", F.col("x.key").alias("key"), beside.alias("beside"))
    aligned = pairs.join(F.broadcast(items) if small else items, "key").withColumn("bare", F.transform("beside", _bare)).drop("key")
    cut, p_cut = store(aligned, "bench-aligned")  # also keeps the steps below from being computed for each element
    clash = F.transform("earlier", lambda e, i: F.when((e >= 0) & (F.get("bare", e) != F.get("bare", i)), e).otherwise(-1))
    marked, p_marked = store(cut.select("doc_id", "text_hash", "item_id", "item", "item_bare", "bare", F.transform(
        F.arrays_zip("item", "item_template", "item_bare", "bare", F.transform("beside", _template).alias("template"), clash.alias("clash")), lambda x: F.struct(
            F.coalesce((x["item_template"] == x["template"]) | (x["item_bare"] == x["bare"]), F.lit(False)).alias("same"),
            F.coalesce(x["item_bare"] == x["bare"], F.lit(False)).alias("equal"),
            (x["item_template"] == x["item"]).cast("int").alias("literal"), x["clash"].alias("clash"))).alias("marks")), "bench-marked")
    best = marked.withColumn("best", F.expr(_BEST)).filter("best.run > 0")
    pick = F.slice(F.arrays_zip("item", "item_bare", "bare"), F.col("best.end") - F.col("best.run") + 1, F.col("best.run"))
    filled = best.select("doc_id", "text_hash", "item_id", F.col("best.run").alias("run"), F.filter(pick, lambda p: _is_slot(p["item"])).alias("slots"))
    counted = filled.select("doc_id", "text_hash", "item_id", "run", F.size("slots").alias("slots"),
                            F.size(F.filter("slots", lambda p: p["item_bare"] != p["bare"])).alias("changed"))
    found, p_found = store(counted.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("run", "slots", "changed")).alias("m")).select(
        "doc_id", "text_hash", "item_id", "m.run", "m.slots", F.col("m.changed").alias("changed_slots")), "bench-found")
    drop(spark, p_items, p_windows, p_hits, p_cut, p_marked)
    return found, [p_found]


def judge(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept``: false where the row shares a run with an item. Other columns stay, but for one that is called kept."""
    hit = found.select(F.col("doc_id").alias("_d_"), F.col("text_hash").alias("_h_"), F.lit(True).alias("_hit_")).distinct()
    joined = docs.withColumn("_hash_", F.xxhash64(text)).join(hit, F.col(id_col).eqNullSafe(F.col("_d_")) & (F.col("_hash_") == F.col("_h_")), "left")
    return joined.withColumn("kept", F.col("_hit_").isNull()).drop("_hash_", "_d_", "_h_", "_hit_")


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no run with an item, with their own columns."""
    hit = found.select(F.col("doc_id").alias("_d_"), F.col("text_hash").alias("_h_")).distinct()
    return docs.join(hit, docs[id_col].eqNullSafe(F.col("_d_")) & (F.xxhash64(docs[text]) == F.col("_h_")), "left_anti")
