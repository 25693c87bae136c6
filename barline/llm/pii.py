"""Personal data: pattern spans, and information-theoretic sanitisation around them.

Pattern matches (email, ip, card, phone) are the protected entities.  Terms of their documents
are weighed by what they disclose: over the whole corpus, the share P(entity | term) of the
documents with the term that hold the entity as well.  Terms beyond ``generalise_at`` are
replaced by a class, beyond ``remove_at`` they are removed, at every place of every text.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import materialise, row_key

KINDS = ("email", "ip", "card", "phone", "term")

# The contract's patterns, written so that Java's matcher neither recurses nor rescans: repeats are
# possessive where nothing after them could use what they give back, and a match can only start
# where the run of characters before it starts (or where the last match ended).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
# Matches of the contract's card pattern are the maximal runs of digits with single separators;
# only runs of 16 to 19 digits can pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![0-9])(?![\x20-][0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{N}_￿])\p{L}{3,}(?![\p{L}\p{N}_￿])"

_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, op, *, step: int = 128) -> Column:
    """``op`` (sum or greatest of numbers not below 0) over the elements up to each place.  Blocks of
    ``step`` elements and the blocks' own results keep it near linear in the number of elements."""

    def upto(a: Column, first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(a, first, count), F.lit(0), op)

    def whole(w: Column) -> Column:
        last = F.greatest(F.floor((F.size(w) - 1) / step), F.lit(0)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: upto(w, b * step + 1, F.lit(step)))
        heads = _let(blocks, lambda own: F.transform(own, lambda _, b: upto(own, F.lit(1), b)))

        def place(head: Column) -> Column:
            return F.transform(w, lambda _, i: op(F.get(head, F.floor(i / step).cast("int")), upto(w, i - i % step + 1, i % step + 1)))

        return _let(heads, place)

    return _let(values, whole)


def _matches(text: Column, pattern: str | Column, kind: int) -> Column:
    """Leftmost non-overlapping matches and the lengths of what ``split`` leaves between them."""
    pattern = F.lit(pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.struct(F.lit(kind).alias("kind"), found.alias("m"), F.transform(F.split(text, pattern, -1), F.length).alias("g"))


def _spans(matches: list[Column]) -> Column:
    """Spans of all ``matches`` with code-point bounds, which the gaps between them give."""

    def placed(x: Column) -> Column:
        ends = _running(F.transform(x["m"], lambda m, i: F.length(m) + F.get(x["g"], i)), lambda u, v: u + v)

        def span(m: Column, end: Column) -> Column:
            return F.struct(x["kind"].alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"))

        return _let(ends, lambda e: F.transform(x["m"], lambda m, i: span(m, F.get(e, i))))

    return F.flatten(F.transform(F.array(*matches), placed))


def _rewritten(text: Column, spans: Column, by) -> Column:
    """``text`` with ``by`` (of a span and the end of what is before it) at each of ``spans``, an array of
    (start, end, ...); what lies between spans stays.  Pieces of the text are read from chunks, so that none
    is sought from the beginning."""
    size = 1024

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / size).cast("int")
        joined = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / size).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(joined, a - first * size + 1, b - a)).otherwise("")

    def whole(x: Column) -> Column:
        def joined(reach: Column) -> Column:
            def before(i: Column) -> Column:
                return F.coalesce(F.get(reach, i - 1), F.lit(0))

            def part(s: Column, i: Column) -> Column:
                return F.concat(piece(x["chunks"], before(i), F.greatest(s["start"], before(i))), by(s, before(i)))

            tail = piece(x["chunks"], before(F.size(x["s"])), F.length(x["t"]))
            return F.concat(F.array_join(F.transform(x["s"], part), ""), tail)

        return _let(_running(F.transform(x["s"], lambda s: s["end"]), lambda u, v: F.greatest(u, v)), joined)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return _let(F.struct(F.array_sort(spans).alias("s"), chunks.alias("chunks"), text.alias("t")), whole)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) of the pattern matches that pass, by kind, then start."""
    none = F.array().cast("array<string>")

    def where(test: Column, pattern: str, kind: int) -> Column:
        empty = F.struct(F.lit(kind).alias("kind"), none.alias("m"), F.array().cast("array<int>").alias("g"))
        return F.when(test, _matches(text, pattern, kind)).otherwise(empty)

    def octets(s: Column) -> Column:
        return F.forall(F.split(s["value"], r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))

    def passes(s: Column) -> Column:
        luhn = F.call_function("luhn_check", _digits(s["value"]))
        return F.when(s["kind"] == 1, octets(s)).when(s["kind"] == 2, luhn).when(s["kind"] == 3, F.length(_digits(s["value"])).between(8, 15)).otherwise(True)

    tests = [F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"[0-9][\x20-]?[0-9]"), F.contains(text, F.lit("+"))]
    found = [where(t, p, k) for k, (t, p) in enumerate(zip(tests, (EMAIL, IP, CARD, PHONE)))]
    return F.coalesce(F.filter(_spans(found), passes), F.array().cast(_SPAN))


def entity(span: Column) -> Column:
    """What makes two spans the same entity: case-folded addresses, digits of numbers."""
    return F.concat_ws(":", span["kind"].cast("string"), F.when(span["kind"] < 2, F.lower(span["value"])).otherwise(_digits(span["value"])))


def _masked(text: Column, base: Column) -> Column:
    """``text`` with marks, which no term may touch, in place of the entities."""
    spans = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    done = _rewritten(text, spans, lambda s, at: F.repeat(F.lit("￿"), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0))))
    return F.when(F.size(base) == 0, text).otherwise(done)


def _words(text: Column) -> Column:
    """Distinct terms of a text, as written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def term_documents(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """Number of rows of ``docs`` that hold each of ``terms`` (term): (term, df).

    The words of all texts are counted, pre-aggregated by task, before they meet the terms.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0)))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term")


def telling_terms(rows: DataFrame, base: DataFrame, *, min_support: int, generalise_at: float, remove_at: float, min_bits: float, min_npmi: float) -> DataFrame:
    """(term, remove) of the terms that disclose some entity.

    Beside the share, which decides, the mutual information must reach ``min_npmi`` of what it is
    at P(entity | term) = 1: an entity that stands in most documents is not told by words that are
    merely common.
    """
    n_docs = base.count()
    private = base.where(F.size("entities") > 0)
    seen = private.select("__id", F.explode("entities").alias("entity"))
    often = materialise(seen.groupBy("entity").agg(F.count("*").alias("de")).where(F.col("de") >= min_support), "pii-entities")
    # A term's documents with some entity number at least those with a given one: terms that this
    # bound already puts below the threshold never meet the entities.
    held = private.select("__id", F.explode("words").alias("term"))
    some = held.groupBy("term").agg(F.count("*").alias("least")).where(F.col("least") >= min_support)
    some = materialise(some, "pii-terms")
    df = term_documents(rows, some.select("term"), "__text")
    some = materialise(some.join(df, "term").where(F.col("least") >= generalise_at * F.col("df")).select("term", "df"), "pii-likely")
    together = held.join(some, "term").select("__id", "term").join(seen.join(often, "entity").select("__id", "entity"), "__id").groupBy("entity", "term").agg(F.count("*").alias("together"))
    strength = together.where(F.col("together") >= min_support).join(some, "term").join(often, "entity")
    share = F.col("together") / F.greatest(F.col("df"), F.col("together"))
    base_rate = F.col("de") / F.lit(float(max(1, n_docs)))
    bits = F.log2(share / base_rate)
    told = strength.where((share >= generalise_at) & (base_rate < 1) & (bits >= min_bits) & (bits >= min_npmi * F.log2(1 / base_rate)))
    return told.groupBy("term").agg(F.max(share >= remove_at).alias("remove"))


def term_places(rows: DataFrame, told: DataFrame, *, broadcast_rows: int = 500_000) -> DataFrame:
    """(__rk, terms): every place of the terms ``told`` in ``rows`` (__rk, __text), but within entities."""
    told = F.broadcast(told) if told.count() <= broadcast_rows else told
    forms = rows.select("__rk", F.explode(_words(F.col("__text"))).alias("form")).withColumn("term", F.lower("form")).join(told, "term")
    forms = forms.groupBy("__rk").agg(F.collect_set("form").alias("forms"), F.collect_set(F.when(F.col("remove"), F.col("form"))).alias("gone"))
    texts = rows.join(forms, "__rk").withColumn("found", _masked(F.col("__text"), base_spans(F.col("__text"))))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_￿])(?:"), F.array_join("forms", "|"), F.lit(r")(?![\p{L}\p{N}_￿])"))
    places = F.transform(_spans([_matches(F.col("found"), pattern, 4)]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array_contains("gone", s["value"]).alias("remove")))
    return texts.select("__rk", places.alias("terms")).groupBy("__rk").agg(F.first("terms").alias("terms"))


def find(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_support: int = 3, generalise_at: float = 0.5, remove_at: float = 0.9, min_bits: float = 0.0, min_npmi: float = 0.5) -> DataFrame:
    """All spans of each row: (key, __rk, base array, terms array).

    Null texts are empty; texts without a match have empty arrays; repeated rows get equal spans
    (they count as documents of their own in the statistics); of matches that start together all are
    given; long texts are read whole, in time nearly linear in their matches; an empty table gives an
    empty result; columns but ``key`` and ``text`` are ignored.  ``__rk`` identifies the row's content.
    """
    rows = docs.select(F.col(key).alias(key), row_key(key, text).alias("__rk"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    base = rows.withColumn("base", base_spans(F.col("__text")))
    words = F.when(F.size("base") > 0, F.array_distinct(F.transform(_words(_masked(F.col("__text"), F.col("base"))), F.lower)))
    base = base.select(key, "__rk", F.monotonically_increasing_id().alias("__id"), F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"), F.array_distinct(F.transform("base", entity)).alias("entities"), words.alias("words"))
    base = materialise(base, "pii-base")
    told = materialise(telling_terms(rows, base, min_support=min_support, generalise_at=generalise_at, remove_at=remove_at, min_bits=min_bits, min_npmi=min_npmi), "pii-told")
    hits = term_places(rows.select("__rk", "__text"), told)
    none = F.array().cast("array<struct<start:int,end:int,remove:boolean>>")
    return base.select(key, "__rk", "base").join(hits, "__rk", "left").withColumn("terms", F.coalesce("terms", none))


def sanitise(docs: DataFrame, *, text: str = "text", key: str = "doc_id", **thresholds) -> DataFrame:
    """``docs`` with every span replaced: entities by their kind, telling terms by a class mark or by
    nothing.  Texts without spans stay as they are (null stays null); all columns are kept."""
    found = find(docs, text=text, key=key, **thresholds).where("size(base) + size(terms) > 0")
    entity_spans = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit(">")).alias("by")))
    term_spans = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["remove"], F.lit("")).otherwise(F.lit("<TERM>")).alias("by")))
    spans = found.groupBy("__rk").agg(F.first(F.array_sort(F.concat(entity_spans, term_spans))).alias("__spans"))
    joined = docs.withColumn("__rk", row_key(key, text)).join(spans, "__rk", "left")
    t = F.col(text)
    done = _rewritten(t, F.col("__spans"), lambda s, at: F.when(s["start"] >= at, s["by"]).otherwise(""))
    clean = F.when(F.col("__spans").isNull(), t).otherwise(done)
    return joined.withColumn(text, clean).select(*docs.columns)


def op3_pii(docs: DataFrame) -> DataFrame:
    """Contract of op3; ``terms`` are the spans that the method adds (kind ``term``)."""
    found = find(docs)
    name = F.array(*map(F.lit, KINDS))

    def written(s: Column) -> Column:
        return F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))

    base = F.transform("base", written)
    more = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    kinds = F.transform("base", lambda s: s["kind"])
    count = [F.size(F.array_remove(F.transform(kinds, lambda x: (x == k).cast("int")), 0)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *count, F.sha2(F.concat_ws(",", base).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.concat(base, more)).alias("spans"))
