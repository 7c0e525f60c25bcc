"""Personal data in texts, and the terms that give it away (DataFrame functions only).

Patterns find base spans: e-mail and IP addresses, card and phone numbers.  Each value found is a protected entity.  How
much a term discloses of an entity is their pointwise mutual information over documents, as a share of the entity's own
information: log(N df(e, t) / (df(e) df(t))) / log(N / df(e)).  It is 1 for a term that is nowhere without the entity.
In all documents, terms above the lower threshold are generalised and those above the upper one removed.  Terms are words of
letters and digits of any length.
Every entity counts, also one that is seen once: a pair counts if the term is within NEAR words of the entity in any text, or if
two different texts hold both; without a window (`near` is None) every pair counts that a text holds.  In fewer than SUPPORT texts the term's share of documents with the entity is smoothed by one
more document.  No term discloses an entity that is in every document: such an entity has no information (a ratio of 0).

Positions come from what lies between matches, in code points.  Patterns are possessive, so their time is linear in a
text's length; n spans of a text take time n and, at a cost far below, n^2 / 2^17.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._arrow import keep, prepare

# fixed values: kinds in their order, and the patterns that are asked for, in linear form
KINDS = ["email", "ip", "card", "phone", "term", "removed"]
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",  # of fewer digits none is kept, and runs don't touch
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRIGGERS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{M}\p{N}]++"
#: Disclosure above which terms are generalised, and removed; different texts from which a pair's shares are not smoothed.
GENERALISED, REMOVED, SUPPORT = 0.85, 0.97, 3
#: Words on either side of an entity that count as near it; what encloses an entity's mark.
NEAR, MARKS = 8, "\ue000\ue001"
#: Slots of the filters that keep what can't match out of shuffles; a broadcast of as many numbers at most.
SLOTS = 1 << 21
#: Spans that are folded one by one, code points of the pieces that texts are cut from, and beyond any text's end.
BLOCK, PIECE, END = 256, 512, (1 << 31) - 1
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def once(value: Column, use) -> Column:
    """use(value), the value being computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, value, plus, zero: int) -> Column:
    """For each item what the values before it come to by `plus`, from `zero`.

    Blocks of BLOCK items are folded first, then each block from what the blocks before it come to, so that no array is
    copied for each item.
    """
    extend = lambda a, v: F.concat(a, F.array(plus(F.element_at(a, -1), v)))

    def fold(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / BLOCK).cast("int"), F.lit(1)) - 1), lambda k: F.slice(x, k * BLOCK + 1, BLOCK))
        return once(blocks, lambda b: once(F.aggregate(F.transform(b, lambda y: F.aggregate(y, F.lit(zero), lambda a, v: plus(a, value(v)))), F.array(F.lit(zero)), extend), lambda first: each(b, first)))

    def each(blocks: Column, first: Column) -> Column:
        inside = lambda y, k: F.slice(F.aggregate(y, F.array(F.element_at(first, k + 1)), lambda a, v: extend(a, value(v))), 1, F.size(y))
        return F.flatten(F.transform(blocks, inside))

    return once(items, fold)


def located(text: Column, pattern: Column, kind: Column) -> Column:
    """Spans of all matches, leftmost and not overlapping, as SPAN."""
    matches, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b")))

    def placed(pairs: Column) -> Column:
        before = running(pairs, lambda x: x["b"] + F.length(x["m"]), lambda a, b: a + b, 0)
        span = lambda x, at: F.struct((at + x["b"]).alias("start"), kind.alias("kind"), (at + x["b"] + F.length(x["m"])).alias("end"), x["m"].alias("value"))
        return F.zip_with(pairs, before, span).cast(SPAN)

    return once(pairs, placed)


def parts(text: Column) -> Column:
    """A text's pieces of PIECE code points, from which `cut` takes ranges without walking the text."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text in pieces; none if end is not greater."""
    first = F.floor(start / PIECE).cast("int")
    among = F.slice(pieces, first + 1, F.greatest(F.ceil(end / PIECE).cast("int") - first, F.lit(0)))
    return F.when(end > start, F.array_join(among, "").substr(start - first * PIECE + 1, end - start)).otherwise("")


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with mark(span) in the place of each span.  Spans are in order; mark gets whether its span begins within earlier ones."""

    def put(spans: Column, pieces: Column) -> Column:
        reached = running(spans, lambda s: s["end"], F.greatest, 0)
        filled = F.zip_with(spans, reached, lambda s, at: F.concat(cut(pieces, at, s["start"]), mark(s, s["start"] < at)))
        rest = cut(pieces, F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)), F.length(text))
        return F.concat(F.array_join(filled, ""), rest)

    return once(spans, lambda s: once(parts(text), lambda p: put(s, p)))


def luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        d = reverse.substr(k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match is kept."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= "255"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    none = F.array().cast(SPAN)
    found = []
    for k, kind in enumerate(KINDS[:4]):
        may = text.rlike("[0-9]") if kind != "email" else F.lit(True)
        if TRIGGERS[kind]:
            may = F.contains(text, F.lit(TRIGGERS[kind])) & may
        keeps = lambda of: lambda s: holds(of, s["value"])
        spans = F.filter(located(text, F.lit(PATTERNS[kind]), F.lit(k)), keeps(kind))
        found.append(F.when(may, spans).otherwise(none))
    return F.array_sort(F.concat(*found))


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def met_words(text: Column, spans: Column) -> Column:
    """The words of a text in order, lower-cased, and in the place of each base span its entity's hash as a mark.

    The words of an e-mail address follow its mark, as they may stand elsewhere too; numbers are no words of their own.
    """
    mark = lambda s, _: F.concat(F.lit(MARKS[0]), entity(s).cast("string"), F.lit(MARKS[1]), F.when(s["kind"] == 0, s["value"]).otherwise(""))
    marked = replaced(F.translate(text, MARKS, "  "), spans, mark)
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"{MARKS[0]}-?[0-9]++{MARKS[1]}|{TERM}"), F.lit(0))


def entity(span: Column) -> Column:
    return F.xxhash64(span["kind"], F.lower(span["value"]))


def hashes(text: Column) -> Column:
    """Each word of a text once, lower-cased, by hash."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(t)))


def passing(hashes_: Column, wanted: DataFrame, name: str) -> DataFrame:
    """The slots of the wanted hashes: a broadcast of at most SLOTS rows, whatever the corpus is, that lets by all that
    can meet them and few others.  The exact join follows."""
    return F.broadcast(wanted.select(F.pmod(hashes_, F.lit(SLOTS)).alias(name)).distinct())


def only(rows: DataFrame, hash_: str, wanted: DataFrame) -> DataFrame:
    """The rows whose hash may be among the wanted frame's column `hash`."""
    slots = passing(F.col("hash"), wanted, "_slot")
    return rows.join(slots, F.pmod(F.col(hash_), F.lit(SLOTS)) == F.col("_slot"), "left_semi")


def disclosing(docs: DataFrame, near: int | None = NEAR) -> DataFrame:
    """(hash, kind) of each term to generalise or to remove, from the text of all documents; for near see find."""
    spans = base_spans(F.col("text"))
    found = keep(docs.where(F.size(spans) > 0).select(F.monotonically_increasing_id().alias("uid"), "text", spans.alias("spans")))
    words = found.select("uid", F.xxhash64("text").alias("content"), met_words(F.col("text"), F.col("spans")).alias("words"))
    is_mark = lambda w: F.startswith(w, F.lit(MARKS[0]))
    places = F.filter(F.transform("words", lambda w, k: F.when(is_mark(w), F.struct(w.alias("mark"), k.alias("k")))), lambda x: x.isNotNull())
    reach = near or 0
    window = lambda k: F.slice("words", F.greatest(k + 1 - reach, F.lit(1)), reach + 1 + F.least(k, F.lit(reach)))
    around = F.transform(places, lambda x: F.struct(F.translate(x["mark"], MARKS, "").cast("bigint").alias("entity"), F.filter(window(x["k"]), lambda w: ~is_mark(w)).alias("near")))
    held = words.select("uid", "content", F.explode(around).alias("x")).groupBy("uid", "x.entity").agg(F.first("content").alias("content"), F.array_distinct(F.flatten(F.collect_list("x.near"))).alias("near"))
    held = keep(held)
    sums = held.groupBy("entity").agg(F.count("*").alias("df_e"), F.count_distinct("content").alias("contents"))
    # all words of a text meet entities of two or more texts, those of the window the others; without a window all meet all
    every = F.array_distinct(F.filter("words", lambda w: ~is_mark(w)))
    common = held.join(sums.where("contents > 1").select("entity", "df_e"), "entity")
    close = F.lit(True) if near is None else F.array_contains("near", F.col("term"))
    spread = lambda df: df.join(words.select("uid", every.alias("words")), "uid").select("entity", "df_e", "content", "near", F.explode("words").alias("term"))
    far = spread(common).select("entity", "df_e", "content", "term", close.alias("close"))
    single = held.join(sums.where("contents = 1").select("entity", "df_e"), "entity")
    if near is None:
        # entities of one text only are all in its copies and meet the same words there, so one of them stands for all
        single = spread(single.groupBy("uid", "content", "df_e").agg(F.min("entity").alias("entity"), F.first("near").alias("near")))
    else:
        single = single.select("entity", "df_e", "content", F.explode("near").alias("term"))
    met = far.unionByName(single.select("entity", "df_e", "content", "term", F.lit(True).alias("close"))).groupBy("entity", "term").agg(F.first("df_e").alias("df_e"), F.count("*").alias("df_et"), F.count_distinct("content").alias("contents"), F.bool_or("close").alias("close"))
    met = keep(met.where("close or contents > 1").withColumn("hash", F.xxhash64("term")))
    # every document counts a term once; words that can't be terms stay out of the shuffle
    counted = only(docs.select(F.explode(hashes(F.col("text"))).alias("hash")), "hash", met).groupBy("hash").agg(F.count("*").alias("df_t"))
    rows = docs.agg(F.count("*").alias("rows"))
    prior = F.col("df_e") / F.col("rows")
    # with fewer texts, as if one more document held the term, and the entity at its usual rate
    more = F.when(F.col("contents") >= SUPPORT, 0.0).otherwise(1.0)
    given = (F.col("df_et") + more * prior) / (F.col("df_t") + more)
    # an entity of all documents has no information of its own to give away
    ratio = F.coalesce(F.try_divide(F.log(given / prior), -F.log(prior)), F.lit(0.0))
    judged = met.join(counted, "hash").crossJoin(F.broadcast(rows)).withColumn("ratio", ratio).where(F.col("ratio") >= GENERALISED)
    return keep(judged.groupBy("hash").agg(F.when(F.max("ratio") >= REMOVED, 5).otherwise(4).alias("kind")))


def with_terms(docs: DataFrame, near: int | None = NEAR) -> DataFrame:
    """docs (doc_id, text and others) with `spans`, the base spans, and `more`: those of disclosing terms that don't overlap them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64("doc_id", text).alias("_row"))
    # rows are known by hash; equal rows have the same terms
    terms = disclosing(texts, near)
    hit = only(texts.select("_row", F.explode(hashes(F.col("text"))).alias("hash")), "hash", terms).join(terms, "hash")
    by_row = keep(hit.groupBy("_row").agg(F.collect_set(F.when(F.col("kind") == 4, F.col("hash"))).alias("_4"), F.collect_set(F.when(F.col("kind") == 5, F.col("hash"))).alias("_5")))
    # documents that can hold no term are not shuffled to learn that
    slots = passing(F.col("_row"), by_row, "_slot")
    known = docs.withColumn("_row", F.xxhash64("doc_id", text))
    at = F.pmod(F.col("_row"), F.lit(SLOTS)) == F.col("_slot")
    joined = known.join(slots, at, "left_semi").join(by_row, "_row", "left").withColumn("spans", base_spans(text))
    apart_from = known.join(slots, at, "left_anti").drop("_row").withColumns({"spans": base_spans(text), "more": F.array().cast(SPAN)})
    none = F.array().cast(SPAN)
    forms = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))

    def of(kind: int) -> Column:
        chosen = F.filter(forms, lambda t: F.array_contains(f"_{kind}", F.xxhash64(F.lower(t))))
        edge = TERM.removesuffix("++")
        pattern = F.concat(F.lit(rf"(?<!{edge})(?:"), F.array_join(chosen, "|"), F.lit(rf")(?!{edge})"))
        return F.when(F.size(f"_{kind}") > 0, located(text, pattern, F.lit(kind))).otherwise(none)

    return joined.withColumn("more", apart(F.col("spans"), F.concat(of(4), of(5)))).drop("_row", "_4", "_5").unionByName(apart_from)


def apart(spans: Column, terms: Column) -> Column:
    """The terms that overlap none of the base spans, by start; both are SPAN, and terms don't overlap each other."""
    base = lambda x: x["kind"] < 4

    def chosen(every: Column) -> Column:
        # of the base spans that begin before a term or with it the furthest end, of the others the first start
        reached = running(every, lambda x: F.when(base(x), x["end"]).otherwise(0), F.greatest, 0)
        ahead = F.reverse(running(F.reverse(every), lambda x: F.when(base(x), x["start"]).otherwise(END), F.least, END))
        free = F.filter(F.arrays_zip(every.alias("x"), reached.alias("reached"), ahead.alias("ahead")), lambda z: ~base(z["x"]) & (z["reached"] <= z["x"]["start"]) & (z["ahead"] >= z["x"]["end"]))
        return F.transform(free, lambda z: z["x"])

    return once(F.array_sort(F.concat(spans, terms)), chosen)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span's kind in its place; removed terms leave nothing.  Spans that overlap are one, named by the first."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:5]], F.lit(""))
    return replaced(text, spans, lambda s, inside: F.when(inside, "").otherwise(F.element_at(marks, s["kind"] + 1)))


def find(docs: DataFrame, near: int | None = NEAR) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    Null is the empty text: no spans, and the digest of nothing.  Repeated rows are documents of their own in all counts, but
    the same text is one text of a pair's support.  An entity of all documents has no disclosing terms.  Other columns are ignored; an empty frame gives an empty frame.
    Words meet an entity within `near` words of it, or in two different texts; where near is None, in every text that has both.
    """
    prepare(docs.sparkSession)
    told_of = with_terms(docs.select("doc_id", "text"), near)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == F.lit(k))).cast("bigint")
    return told_of.select("doc_id", *[number(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(told(F.col("spans")), 256).alias("base_sha256"), told(F.array_sort(F.concat("spans", "more"))).alias("spans"))


def sanitise(docs: DataFrame, near: int | None = NEAR) -> DataFrame:
    """docs with the same columns, their texts sanitised; texts without spans, null ones too, are as they were.  For near see find."""
    prepare(docs.sparkSession)
    at = {c: c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)}
    spanned = with_terms(docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in docs.columns]), near).withColumn("spans", F.array_sort(F.concat("spans", "more")))
    text = F.when(F.size("spans") > 0, sanitised(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return spanned.select(*[(text if c == "text" else F.col(at[c])).alias(c) for c in docs.columns])
