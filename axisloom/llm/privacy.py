"""Personal data and the terms that give it away: information-theoretic sanitisation in expressions only.

1. *Base spans.*  E-mail addresses, IP addresses, card and phone numbers are found by
   pattern in whole texts; each is a protected entity (its value in a normal form).
2. *Contexts.*  The ``WINDOW`` words before and after an entity, up to the next one.
3. *Corpus statistics.*  With N texts, c(t) texts that hold term t, c(e) that hold entity e
   and c(t, e) that have t in a context of e, knowing t tells

       PMI(t; e) = log(c(t, e) N / (c(t) c(e)))  of the  IC(e) = log(N / c(e))

   bits that e is worth.  A term whose share PMI / IC reaches ``GENERALISE`` is replaced
   by its kind in the contexts of e, from ``REMOVE`` on it is removed.  Evidence must come
   from ``MIN_CONTEXTS`` different contexts, so copies of one text prove nothing.

Patterns are the plain ones with possessive repeats and a bound on where a match may
start: the same matches, without backtracking, in time linear in the text.  All
positions are code points.  No Python runs over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored

KINDS = ("email", "ip", "card", "phone")
#: fixed values: what the base kinds look like, see above for how they differ from the plain forms
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
WORD = r"[\p{L}\p{N}]++"

WINDOW = 8
#: shorter words are no terms
LEAST_TERM = 3
MIN_CONTEXTS = 3
GENERALISE, REMOVE = 0.7, 0.9
#: so many telling pairs are sent to every task; more are joined by a shuffle
BROADCAST_ROWS = 100_000
#: elements whose running sums are built by appending
CHUNK = 32


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column) -> Column:
    """Sums of all numbers before each: in chunks, so that long arrays stay cheap."""
    grow = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / CHUNK).cast("int")),
        lambda i: grow(F.slice(numbers, i * CHUNK + 1, F.lit(CHUNK))),
    )
    return let(
        chunks,
        lambda c: let(
            grow(F.transform(c, lambda x: F.element_at(x, -1))),
            lambda base: F.flatten(F.zip_with(c, F.slice(base, F.lit(1), F.size(c)), lambda x, b: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda v: v + b))),
        ),
    )


SPAN = "array<struct<start:int,end:int,value:string>>"


def none(kind: str) -> Column:
    return F.array().cast(kind)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost, non-overlapping matches."""

    def placed(hits: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        sized = F.zip_with(pieces, hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("size"), h.alias("value")))
        return let(
            sized,
            lambda s: F.zip_with(
                s, running(F.transform(s, lambda x: x["gap"] + x["size"])),
                lambda x, before: F.struct(
                    (before + x["gap"]).alias("start"), (before + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")
                ),
            ),
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, none(SPAN)).otherwise(placed(hits)),
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the checksum of a string of digits is right."""

    def total(d: Column) -> Column:
        def add(s, i):
            digit = F.ascii(F.substring(d, F.length(d) - i, F.lit(1))) - 48
            twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
            return s + F.when(i % 2 == 1, twice).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)

    return let(number, total) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds; ``value`` is the entity in its normal form."""
    some = lambda sign, found: F.when(F.contains(text, F.lit(sign)), found).otherwise(none(SPAN))
    as_digits = lambda found: F.transform(found, lambda x: x.withField("value", digits(x["value"])))
    size = lambda x: F.length(x["value"])
    card = F.filter(as_digits(matches(text, CARD)), lambda x: F.when(size(x).between(16, 19), luhn(x["value"])).otherwise(False))
    return {
        "email": some("@", F.transform(matches(text, EMAIL), lambda x: x.withField("value", F.lower(x["value"])))),
        "ip": some(".", F.filter(matches(text, IP), lambda x: x["value"].rlike(IP_VALID))),
        "card": card,
        "phone": some("+", F.filter(as_digits(matches(text, PHONE)), lambda x: size(x).between(8, 15))),
    }


def _first_words(text: Column, n: int) -> Column:
    """The text up to the end of its n-th word."""
    return F.regexp_extract(text, rf"^(?:[^\p{{L}}\p{{N}}]*+{WORD}){{0,{n}}}", 0)


def _terms(text: Column, at: Column) -> Column:
    """Terms of a short text that stands at a place: words with a letter and of some length."""
    long = F.filter(matches(text, WORD), lambda x: (F.length(x["value"]) >= LEAST_TERM) & x["value"].rlike(r"\p{L}"))
    return F.transform(long, lambda x: F.struct(F.lower(x["value"]).alias("term"), (x["start"] + at).alias("start"), (x["end"] + at).alias("end")))


CONTEXT = "array<struct<entity:string,context:bigint,term:string,start:int,end:int>>"


def contexts(text: Column, spans: Column, window: int) -> Column:
    """Every term near every entity.  ``spans``: entity, start, end, sorted by start."""
    last = F.size(spans)
    # entities may overlap: at most one per kind can reach over the next ones
    end_before = lambda i: F.greatest(F.lit(0), *(F.coalesce(F.get(spans, i - k)["end"], F.lit(0)) for k in range(1, len(KINDS))))

    def near(i: Column) -> Column:
        x = F.get(spans, i)
        gap_before = F.substring(text, end_before(i) + 1, F.greatest(F.lit(0), x["start"] - end_before(i)))
        until = F.when(i + 1 < last, F.get(spans, i + 1)["start"]).otherwise(F.length(text))
        gap_after = F.substring(text, x["end"] + 1, F.greatest(F.lit(0), until - x["end"]))
        before = let(F.reverse(_first_words(F.reverse(gap_before), window)), lambda t: _terms(t, x["start"] - F.length(t)))
        after = _terms(_first_words(gap_after, window), x["end"])
        return let(
            F.concat(before, after),
            lambda all_: let(
                F.xxhash64(F.transform(all_, lambda t: t["term"])),
                lambda h: F.transform(all_, lambda t: F.struct(x["entity"].alias("entity"), h.alias("context"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end"))),
            ),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), last - 1), near))


def found_entities(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, doc_id, hash, email, ip, card, phone, contexts`` per row, stored; a null text is empty.

    ``hash`` is that of the text: rows of one id are told apart by it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def build(s: Column) -> Column:
        named = lambda k: F.transform(s[k], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit(f"{k}:"), x["value"]).alias("entity")))
        every = F.array_sort(F.concat(*(named(k) for k in KINDS)))
        near = F.when(sum(F.size(s[k]) for k in KINDS) > 0, let(every, lambda e: contexts(text, e, window))).otherwise(none(CONTEXT))
        return F.struct(*(named(k).alias(k) for k in KINDS), near.cast(CONTEXT).alias("contexts"))

    spans = F.struct(*(c.alias(k) for k, c in base_spans(text).items()))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("hash"), let(spans, build).alias("f"))
    # written once: row numbers are fixed from here on
    return stored(rows.select("row", "doc_id", "hash", "f.*"), "entities")[0]


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``term, c_t``: the rows that hold each wanted (distinct) term; all words are added up inside the tasks first.

    A plain join: a semi-join would be moved below the sums, to every single word.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"{WORD}"), F.lit(0)))
    held = docs.filter(F.col("text").isNotNull()).select(F.explode(words).alias("term"))
    return held.groupBy("term").agg(F.count("*").alias("c_t")).join(wanted, "term")


def disclosures(
    docs: DataFrame, found: DataFrame, min_contexts: int = MIN_CONTEXTS, threshold: float = GENERALISE
) -> DataFrame:
    """``entity, term, share`` of the terms that tell at least ``threshold`` of an entity, stored.

    An entity that every text holds is worth no bits and has no such terms.
    """
    one = lambda *names: F.explode(F.array_distinct(F.transform("contexts", lambda x: F.struct(*(x[n].alias(n) for n in names))))).alias("x")
    seen = found.select(one("entity", "term", "context")).groupBy("x").count()
    backed = seen.groupBy("x.entity", "x.term").agg(F.count("*").alias("n")).filter(F.col("n") >= min_contexts)
    both = found.select(one("entity", "term")).groupBy("x.entity", "x.term").agg(F.count("*").alias("c_te"))
    entity = F.array_distinct(F.transform(F.concat(*KINDS), lambda x: x["entity"]))
    c_e = found.select(F.explode(entity).alias("entity")).groupBy("entity").agg(F.count("*").alias("c_e"))
    n = found.count()
    share = lambda c_t: 1 - F.log(F.col(c_t) / F.col("c_te")) / F.log(F.lit(float(n)) / F.col("c_e"))
    # rows with t in any context are rows with t: a bound that stops all common words before texts are read again
    c_any = found.select(one("term")).groupBy("x.term").agg(F.count("*").alias("c_any"))
    open_ = backed.join(both, ["entity", "term"]).join(c_e.filter(F.col("c_e") < n), "entity").join(c_any, "term")
    open_ = open_.filter(share("c_any") >= threshold)
    pairs, _ = stored(open_.select("entity", "term", "c_te", "c_e"), "term-pairs")
    terms, _ = stored(pairs.select("term").distinct(), "terms")
    c_t = term_counts(docs, terms)
    told = pairs.join(c_t, "term").select("entity", "term", share("c_t").alias("share"))
    return stored(told.filter(F.col("share") >= threshold), "disclosures")[0]


def personal_spans(
    docs: DataFrame, window: int = WINDOW, min_contexts: int = MIN_CONTEXTS, generalise: float = GENERALISE
) -> DataFrame:
    """``doc_id, hash, email, ip, card, phone, terms``: all spans of every row.

    The first four are ``array<struct<start, end, entity>>``, ``terms`` is
    ``array<struct<start, end, share>>`` with the largest share for a place, all sorted
    by start.  Places are code points, ends exclusive; ``hash`` is xxhash64 of the text.
    A null text is empty; a null id stays; repeated rows each have their row and count
    each; an empty table gives none.
    """
    found = found_entities(docs, window)
    told = disclosures(docs, found, min_contexts, generalise)
    if told.count() <= BROADCAST_ROWS:
        told = F.broadcast(told)
    hits = found.select("row", F.explode("contexts").alias("x")).select("row", "x.*").join(told, ["entity", "term"])
    # a word can stand in the contexts of two entities
    places = hits.groupBy("row", "start", "end").agg(F.max("share").alias("share"))
    terms = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    empty = none("array<struct<start:int,end:int,share:double>>")
    return found.join(terms, "row", "left").select("doc_id", "hash", *KINDS, F.coalesce("terms", empty).alias("terms"))


def span_list(kinds) -> Column:
    """kind:start:end of the columns' spans, comma-joined in the order given."""
    def listed(k: str) -> Column:
        name = F.lit("term" if k == "terms" else k)
        return F.transform(k, lambda x: F.concat_ws(":", name, x["start"].cast("string"), x["end"].cast("string")))

    parts = [listed(k) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def span_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row."""
    return personal_spans(docs).select(
        "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), F.sha2(span_list(KINDS), 256).alias("base_sha256"), span_list([*KINDS, "terms"]).alias("spans")
    )


def sanitised(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The rows with personal data replaced by its kind and telling terms generalised or removed.

    All columns stay.  A generalised term becomes ``[Name]`` when it starts with a capital,
    ``[word]`` otherwise.  Where spans overlap the earlier one holds.  Rows without spans
    (null texts, too) stay as they are.
    """
    spans = personal_spans(docs, generalise=generalise)
    kind = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k}]").alias("put")))
    put = lambda x: F.when(x["share"] >= remove, F.lit("")).otherwise(F.lit(None).cast("string"))
    every = F.array_sort(F.concat(*(kind(k) for k in KINDS), F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), put(x).alias("put")))))
    marked = spans.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), every.alias("_spans")).filter(F.size("_spans") > 0)
    marked = marked.dropDuplicates(["_id", "_hash"])  # equal rows have equal spans
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text"), F.xxhash64("text").alias("hash"))
    text = F.col("text")

    def step(state, x):
        word = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        general = F.when(word.rlike(r"^\p{Lu}"), F.lit("[Name]")).otherwise(F.lit("[word]"))
        gap = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        return F.when(
            x["start"] >= state["at"],
            F.struct(F.concat(state["out"], gap, F.coalesce(x["put"], general)).alias("out"), x["end"].alias("at")),
        ).otherwise(state)

    done = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    whole = let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    joined = own.join(marked, own["id"].eqNullSafe(marked["_id"]) & (own["hash"] == marked["_hash"]), "left")
    clean = F.when(F.col("_spans").isNull(), text).otherwise(whole)
    return joined.select(F.col("row").withField("text", clean).alias("row")).select("row.*")
