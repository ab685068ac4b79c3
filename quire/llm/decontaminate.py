"""Benchmark decontamination by canonical templates; DataFrame functions only.

Texts become lower-case words and numbers. Numbers, names (capitalised words within a sentence) and
units (after a number) become typed placeholders. Windows of five tokens are hashed and joined with
those of the benchmark items, in three forms: with numbers and units as placeholders; with names
too; with every capitalised word as a name, also one that starts a text, line, quotation or
sentence. (A capital may be an accident of where a passage was pasted, so names also count as plain
words.) A window of an item that holds fewer than two plain words goes on until it holds two, back
from the item's end if need be, or is the whole item; documents are also cut at these lengths, and
at those of items of fewer than five tokens. An item of placeholders alone counts word by word, as
it would equal any such run of numbers.

A match is a pair of equal windows, and all pairs at one distance between document and item form an
alignment. Slots are checked within an alignment, where each place of the item meets one place of the
document. Numbers and units are variables by place: a question may be asked again with any others,
equal ones where the item has different ones and the other way round. A name is a variable in all its
places: it stands for what most of its places meet (ties: the smallest). Where 0.8 or more of an
alignment's places of names agree with that, only windows with another filler are no match; where
fewer do, all its windows with names aren't. That is judged with every capitalised word as a name
and, apart from that, without. A document is contaminated by an item if in one of the two 0.8 or
more of the item's windows are matched.

Three passes. An item that lacks no more than a fifth of its windows has one at least among any fifth
and one more, so that many windows of each item are looked for first, those that the fewest items
share and of these those with the longest runs of plain words. Wherever such a window is matched, in
whichever form, its plain words stand in the text as they are, and in a row if numbers are left out.
So the first pass looks for the longest such run of each window in all documents, which takes no forms
at all; it only leaves documents out that hold none. The second pass joins those it finds with the
windows themselves, in all forms; the third looks at what is found then, with all windows. No template
that many items share meets all documents. Runs (a hash) and windows of the second pass (an item and a
hash) are broadcast up to ``broadcast_rows`` of them, 8 and 16 bytes each, and shuffled beyond.

Defined results: null and empty texts match nothing; an item of fewer than five tokens is one window
of all of them. Very long texts are cut between words into pieces that overlap by more than an item;
what starts before a cut is whole in the piece before, and names are also judged by the part behind.
Rows that repeat a doc_id are judged together; of equal windows of an item each counts. Extra
columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WINDOW, COVER, LEAST_WORDS, AGREED = 5, 0.8, 2, 0.8
#: Words for units that follow a number. Fixed values.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg ton tons pound pounds ounce ounces l ml liter liters "
    "litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros degree degrees meter meters metre metres gram grams kilometers kilometres kilograms"
).split()
NAME, LEAD = "", ""
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
PIECE, OVERLAP = 1 << 16, 1 << 13
PLAIN, NAMES, WORDS, WIDE = range(4)


def _pieces(rows: DataFrame, key: str, size: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """``(key, piece, text)``: texts cut after white space where longer than ``size`` characters, each
    piece with ``overlap`` characters of what follows, less a word that this cuts."""
    cut_up = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{size}}}(?!\S)|.{{1,{size}}}"), F.lit(0))
    r = rows.select(key, F.when(F.length("text") <= size, F.array("text")).otherwise(cut_up).alias("p"))

    def more(k: Column) -> Column:
        behind = F.array_join(F.slice("p", k + 2, 1 - -overlap // size), "")
        return F.when(F.length(behind) <= overlap, behind).otherwise(F.regexp_extract(F.substring(behind, 1, overlap), r"(?s)\A(.*\s|\S*\z)", 1))

    whole = F.when(F.size("p") <= 1, F.col("p")).otherwise(F.transform("p", lambda x, k: F.concat(x, more(k))))
    return r.select(key, F.posexplode(whole).alias("piece", "text"))


def _forms(rows: DataFrame, *keys: str) -> DataFrame:
    """``(keys, low, names, leads, numbers)``: lower-case text with its names marked, and what it has."""
    plain = F.replace(F.replace(F.replace(F.col("text"), F.lit("#"), F.lit(" ")), F.lit(NAME), F.lit(" ")), F.lit(LEAD), F.lit(" "))
    # patterns start with what fails soonest; a-z is within \p{L} but tested as one bit
    marked = F.regexp_replace(plain, r"\p{Lu}(?<=[a-z\p{L}\p{N},;] \p{Lu})\p{Ll}+", NAME + "$0")
    marked = F.regexp_replace(marked, rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}{NAME}]\p{{Lu}})\p{{Ll}}+", LEAD + "$0")
    r = rows.select(*keys, F.lower(marked).alias("low"))
    return r.select(*keys, "low", F.contains("low", F.lit(NAME)).alias("names"), F.contains("low", F.lit(LEAD)).alias("leads"), F.rlike("low", F.lit("[0-9]")).alias("numbers"))


def _unmarked() -> Column:
    return F.replace(F.replace(F.col("low"), F.lit(NAME), F.lit("")), F.lit(LEAD), F.lit(""))


def _canonical(form: int) -> Column:
    """PLAIN keeps names as words, NAMES marks those within a sentence, WIDE every capitalised word."""
    name = {NAMES: NAME, WIDE: NAME + LEAD}.get(form)
    t = _unmarked() if name is None else F.regexp_replace(F.col("low") if form == WIDE else F.replace("low", F.lit(LEAD), F.lit("")), rf"[{name}][\p{{L}}\p{{M}}]+", " #name ")
    t = F.when(F.col("numbers"), F.regexp_replace(F.regexp_replace(t, NUMBER, " #number "), rf"#number +(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])", "#number #unit")).otherwise(t)
    return F.trim(F.regexp_replace(t, r"[^#a-z\p{L}\p{M}]+", " "))


def _raw() -> Column:
    """Tokens as they were, one for each token of a canonical form."""
    return F.expr(rf"regexp_extract_all(replace(replace(low, '{NAME}', ''), '{LEAD}', ''), '[\\p{{L}}\\p{{M}}]+|{NUMBER}', 0)")


def _texts(rows: DataFrame, *keys: str, words: bool = True) -> DataFrame:
    """``(keys, form, t)``: the text in every form that differs from the ones before it; the text word
    by word only with ``words``."""
    form = lambda n, t: F.struct(F.lit(n).alias("form"), t.alias("t"))
    forms = [form(PLAIN, _canonical(PLAIN)), F.when(F.col("names"), form(NAMES, _canonical(NAMES))), F.when(F.col("leads"), form(WIDE, _canonical(WIDE)))]
    forms += [F.when(F.col("numbers"), form(WORDS, F.array_join(_raw(), " ")))] * words
    return _forms(rows, *keys).select(*keys, F.explode(F.array_compact(F.array(*forms))).alias("f")).select(*keys, "f.form", "f.t")


def _all_windows(docs: DataFrame, lengths: list[int], words: bool) -> DataFrame:
    """``(doc_id, piece, form, i, h)``: the windows of ``lengths`` tokens. Only templates with windows
    that are mostly placeholders are longer than ``WINDOW``."""
    at = lambda n: F.when(F.size("c") >= n, F.transform(F.sequence(F.lit(1), F.size("c") - (n - 1)), lambda i: F.xxhash64(F.slice("c", i, n))))
    dense = F.rlike("t", F.lit(r"#[a-z]+ #[a-z]+ (?:#|[^ ]+ #[a-z]+ #)"))
    t = _texts(_pieces(docs, "doc_id"), "doc_id", "piece", words=words).where("t <> ''")
    t = t.select("doc_id", "piece", "form", F.split("t", " ").alias("c"), (dense | (F.col("form") == WORDS)).alias("dense"))
    runs = F.array_compact(F.array(*[at(n) if n <= WINDOW else F.when(F.col("dense"), at(n)) for n in lengths]))
    r = t.select("doc_id", "piece", "form", F.explode(runs).alias("run"))
    return r.select("doc_id", "piece", "form", F.posexplode("run").alias("i", "h"))


def _runs(text: DataFrame, token: str, lengths: list[int]) -> DataFrame:
    """``(doc_id, key)``: the hash of ``lengths`` tokens in a row, at each place; fewer at the end of a text."""
    words = F.transform(F.regexp_extract_all(_folded(F.lower("text")), F.lit(token), F.lit(0)), lambda x: F.xxhash64(x))
    # outer, as Spark would else work out the words a second time to see whether there are any
    t = _pieces(text, "doc_id").select("doc_id", words.alias("w")).select("doc_id", "w", F.posexplode_outer("w").alias("i", "x"))
    keys = [F.xxhash64("x", *[F.get("w", F.col("i") + k) for k in range(1, n)]) for n in lengths]
    return t.select("doc_id", F.explode(F.array(*keys)).alias("key"))


def _folded(c: Column) -> Column:
    """Lower case of a final sigma depends on what follows, so also on marks."""
    return F.replace(c, F.lit("\u03c2"), F.lit("\u03c3"))


def _anchor(canon: Column, form: Column) -> Column:
    """The longest run of plain words in a window, numbers left out, up to five; of a window of numbers, these."""
    left = F.array_join(F.filter(canon, lambda c: c != "#number"), " ")
    runs = F.transform(F.split(left, "#name|#unit"), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    longest = F.array_max(F.transform(runs, lambda x: F.struct(F.size(x).alias("size"), x.alias("run"))))["run"]
    return F.slice(F.when(form == WORDS, canon).otherwise(longest), 1, WINDOW)


def item_windows(items: DataFrame) -> DataFrame:
    """``(item_id, j, a, n, form, h, at, filled, anchor)``: window j starts at token a and has n; at and
    filled are the places and fillers of its names; anchor is the run of words to look for."""
    r = _texts(items, "item_id").where("t <> ''").select("item_id", "form", F.split("t", " ").alias("c"))
    r = r.join(_forms(items, "item_id").select("item_id", _raw().alias("raw")), "item_id")
    r = r.withColumn("size", F.size("c")).withColumn("words", F.filter(F.transform("c", lambda c, k: F.when((F.col("form") == WORDS) | ~F.startswith(c, F.lit("#")), k)), lambda k: k.isNotNull()))
    bare = F.forall("raw", lambda x: F.rlike(x, F.lit("^[0-9]")))
    # placeholders alone are any such run of numbers: only word by word, as no other item is
    r = r.where(F.size("words") > 0).where((F.col("form") != WORDS) | bare)
    r = r.withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - WINDOW, F.lit(0)))))
    last = F.get(F.filter("words", lambda k: k >= F.col("j")), F.lit(LEAST_WORDS - 1))
    back = F.coalesce(F.get("words", F.size("words") - LEAST_WORDS), F.lit(0))
    r = r.withColumn("last", last).withColumn("a", F.when(F.col("last").isNull(), F.least("j", back)).otherwise(F.col("j")))
    r = r.withColumn("n", F.when(F.col("last").isNull(), F.col("size")).otherwise(F.greatest(F.least(F.col("j") + WINDOW, "size"), F.col("last") + 1)) - F.col("a"))
    r = r.withColumn("canon", F.slice("c", F.col("a") + 1, F.col("n")))
    at = F.filter(F.transform("canon", lambda c, k: F.when(c == "#name", k)), lambda k: k.isNotNull())
    r = r.select("item_id", "j", "a", "n", "form", F.xxhash64("canon").alias("h"), at.alias("at"), "raw", _anchor(F.col("canon"), F.col("form")).alias("anchor"))
    return r.select("item_id", "j", "a", "n", "form", "h", "at", F.transform("at", lambda k: F.get("raw", F.col("a") + k)).alias("filled"), "anchor").distinct()


def _rarest(asked: DataFrame, sizes: DataFrame, cover: float) -> DataFrame:
    """``(item_id, h, anchor)``: windows of which every item has one that is matched at all."""
    shared = asked.groupBy("h").agg(F.count_distinct("item_id").alias("items"))
    each = asked.join(shared, "h").groupBy("item_id", "j").agg(F.max("items").alias("items"), F.min(F.size("anchor")).alias("run"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("items", F.desc("run"), "j"))
    total = F.count("*").over(Window.partitionBy("item_id"))
    first = each.select("*", nth.alias("nth"), total.alias("total")).join(sizes, "item_id").where((F.col("nth") <= F.col("total") - F.ceil(F.col("n_windows") * cover - 1e-9) + 1))
    return asked.join(first.select("item_id", "j"), ["item_id", "j"], "left_semi").select("item_id", "h", "anchor").distinct()


def _near(text: DataFrame, rare: DataFrame, broadcast_rows: int) -> DataFrame:
    """The documents that hold an anchor of ``rare``; all rows of a doc_id."""
    anchors = cut(rare.select(F.xxhash64(F.transform("anchor", lambda x: F.xxhash64(_folded(x)))).alias("key"), F.size("anchor").alias("n"), F.rlike(F.get("anchor", F.lit(0)), F.lit("^[0-9]")).alias("number")).distinct())
    lengths = defaultdict(list)  # five each at most
    for r in anchors.select("number", "n").distinct().orderBy("number", "n").collect():
        lengths[r.number].append(r.n)
    keys = F.broadcast(anchors.select("key")) if anchors.count() <= broadcast_rows else anchors.select("key")
    runs = [_runs(text, NUMBER if number else r"[a-z\p{L}\p{M}]+", ns) for number, ns in lengths.items()]
    ids = cut(reduce(DataFrame.unionAll, runs).join(keys, "key", "left_semi").select(F.col("doc_id").alias("d")).distinct()) if runs else text.where("false").select(F.col("doc_id").alias("d"))
    return cut(text.join(ids, F.expr("doc_id <=> d"), "left_semi"))


def contaminated(docs: DataFrame, items: DataFrame, cover: float = COVER, broadcast_rows: int = 500_000) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_matched, coverage, n_slots)`` for every document and the
    items it holds; n_slots: names that stand in matched windows. docs(doc_id, text), items(item_id, text)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = cut(item_windows(items))
    sizes = cut(_forms(items, "item_id").groupBy("item_id").agg(F.max(F.greatest(F.size(_raw()) - (WINDOW - 1), F.lit(1))).cast("long").alias("n_windows")))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = asked.groupBy("n", F.expr(f"form = {WORDS}").alias("words")).count().collect()  # a row for each length of a window
    lengths, words = sorted({r.n for r in kinds}) or [WINDOW], any(r.words for r in kinds)

    rare = cut(_rarest(asked, sizes, cover))
    near = _near(text, rare, broadcast_rows)
    rare = F.broadcast(rare.select("item_id", "h")) if rare.count() <= broadcast_rows else rare.select("item_id", "h")
    likely = cut(_all_windows(near, lengths, words).join(rare, "h").select("doc_id", "item_id").distinct())
    those = likely.select(F.col("doc_id").alias("d")).distinct()
    text = cut(near.join(those, F.expr("doc_id <=> d"), "left_semi"))

    seen = _all_windows(text, lengths, words).select("doc_id", "piece", "i", "h", (F.col("form") == WIDE).alias("open"))
    pair = likely.select(F.col("doc_id").alias("d"), F.col("item_id").alias("t"))
    hits = seen.join(asked, "h").join(pair, F.expr("doc_id <=> d and item_id = t"), "left_semi")
    met = F.min((F.col("form") == WIDE) | F.col("open")).alias("wide")
    hits = cut(hits.groupBy("doc_id", "piece", "item_id", "i", "j", "a", "at", "filled").agg(met))
    plain = hits.where(F.size("at") == 0).select("doc_id", "item_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("every"), "j", F.lit(None).cast("string").alias("name"))

    raw = _forms(_pieces(text, "doc_id"), "doc_id", "piece").select(F.col("doc_id").alias("d"), F.col("piece").alias("p"), _raw().alias("raw"))
    # rows that share a doc_id are judged together: a place may have several tokens
    every = F.explode(F.when(F.col("wide"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("every")
    slots = F.transform("at", lambda k, n: F.named_struct(F.lit("place"), F.col("a") + k, F.lit("name"), F.get("filled", n), F.lit("met"), F.get("raw", F.col("i") + k)))
    group = ["doc_id", "piece", "item_id", "apart", "every"]
    named = hits.where(F.size("at") > 0).join(raw, F.expr("doc_id <=> d and piece = p")).select("doc_id", "piece", "item_id", "j", "at", (F.col("i") - F.col("a")).alias("apart"), every, slots.alias("slots"))
    named = cut(named.select(*group, "j", "at", F.explode("slots").alias("s")).select(*group, "j", "at", "s.*"))
    votes = named.groupBy(*group, "name", "met").agg(F.count_distinct("place").alias("votes"))
    stands = votes.groupBy(*group, "name").agg(F.min_by("met", F.struct(-F.col("votes"), "met")).alias("stands_for"), F.max("votes").alias("top"))
    places = named.groupBy(*group).agg(F.count_distinct("place").alias("places")).select(*(F.col(c).alias(c + "_") for c in group), "places")
    agreed = stands.groupBy(*group).agg(F.sum("top").alias("top")).join(places, F.expr(" and ".join(f"{c} <=> {c}_" for c in group))).where(F.col("top") >= F.col("places") * AGREED - 1e-9)
    stands = stands.drop("top").join(agreed.select(*(c + "_" for c in group)), F.expr(" and ".join(f"{c} <=> {c}_" for c in group)), "left_semi")
    same = F.expr(" and ".join(f"{c} <=> {c}_" for c in [*group, "name"]))
    checked = named.join(stands.select(*(F.col(c).alias(c + "_") for c in [*group, "name"]), "stands_for"), same)
    fits = checked.groupBy(*group, "j", "at").agg(F.bool_and(F.col("met").eqNullSafe(F.col("stands_for"))).alias("fits"), F.collect_set("name").alias("names"))
    fine = fits.where("fits").select("doc_id", "item_id", "every", "j", F.explode("names").alias("name"))
    found = plain.unionAll(fine).groupBy("doc_id", "item_id", "every").agg(F.count_distinct("j").alias("n_matched"), F.count_distinct("name").alias("n_slots"))
    found = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "n_slots")).alias("m")).select("doc_id", "item_id", "m.*")
    out = found.join(sizes, "item_id").withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    return out.where(F.col("coverage") >= cover).select("doc_id", "item_id", "n_windows", "n_matched", "coverage", "n_slots")


def decontaminate(docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """The documents that hold no benchmark item; rows without doc_id stay."""
    bad = cut(contaminated(docs, items, cover).select(F.col("doc_id").alias("bad_id")).where("bad_id is not null").distinct())
    return docs.join(bad, docs["doc_id"].cast("long") == bad["bad_id"], "left_anti")
