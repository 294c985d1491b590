"""Personal data and information-theoretic sanitisation, by built-in functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Beyond them, corpus
co-occurrence estimates how strongly a word reveals a protected entity of its text. Entities are
the exact values and, as exact values seldom recur in different texts, what they are known by:
an address's domain and name, a network, an area code, an issuer. With n different texts, of which
n_e hold the entity, n_t the word and n_et both, pointwise mutual information
log2(n * n_et / (n_e * n_t)) is compared with the entity's own information log2(n / n_e). A word that
carries at least ``disclosure`` of it in ``support`` different texts, against evidence of chance
(n_t times the divergence of n_et / n_t from n_e / n, in bits, must exceed those of choosing one
of all words), is a span of its own (kind ``term``). ``sanitise`` generalises base spans to their
kind and removes terms.

Entities are paired with the different words of their whole texts, so pairs grow with the
mentions, and every place of a flagged word in these texts is a span; the frequencies of words are
summed in the tasks before they are shuffled. All four counts are of different texts, so copies
are no evidence.

With ``alike``, near copies are none either. The texts that show a word with an entity are settled by leaders:
the first by hash leads, texts whose different words overlap the leader's by ``alike`` (Jaccard) go with it, and so on
with the rest, ``support - 1`` times. A pair holds if texts are left over, and if its bits, in the
share of the leaders and the left texts, exceed those of choosing one of all pairs of word and entity.
Leaders are compared with their texts only, so the work is linear in the places of flagged pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoflux.llm import exchange as ex
from annoflux.llm import spans as sp
from annoflux.llm.storage import cut

KINDS = ("email", "ip", "card", "phone")
# Possessive and guarded forms of the base patterns: same matches, no deep recursion and no rescans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD = r"\p{L}{3,}+"
#: Share of an entity's information from which a word discloses it, and texts that must show both.
DISCLOSURE = 0.9
SUPPORT = 2
#: Overlap of different words from which two texts are one piece of evidence (for ``alike``).
ALIKE = 0.5
#: Parts into which the rows of a pair of entity and word are dealt when flags come back to them.
SALTS = 16
#: Flagged pairs up to which they are broadcast to the texts (counted; some tens of MB); beyond, the pairs of all texts are shuffled to them.
BROADCAST_ROWS = 500_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, value) by kind."""
    some_digit = text.rlike("[0-9]")
    cards = F.filter(sp.find(text, CARD, some_digit), lambda s: F.length(s["value"]) >= 16)
    return {
        "email": sp.find(text, EMAIL, text.contains("@")),
        "ip": F.filter(sp.find(text, IP, some_digit), lambda s: s["value"].rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")),
        "card": F.filter(
            cards,
            lambda s: F.when(F.length(_digits(s["value"])).between(16, 19), sp.luhn(_digits(s["value"]))).otherwise(False),
        ),
        "phone": F.filter(sp.find(text, PHONE, text.contains("+")), lambda s: F.length(_digits(s["value"])).between(8, 15)),
    }


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _with_base(named: DataFrame) -> DataFrame:
    found = base_spans(F.col("text"))
    return named.withColumns({kind: found[kind] for kind in KINDS})


def _entities() -> Column:
    """Hashes of the protected entities of a text, at every level, from its base spans."""
    value = lambda s: F.lower(s["value"])
    digits = lambda s: _digits(s["value"])
    network = lambda s: F.substring_index(s["value"], ".", 2)
    levels = [
        *[(kind, "value", value) for kind in KINDS],
        ("email", "domain", lambda s: F.substring_index(value(s), "@", -1)),
        ("email", "name", lambda s: F.regexp_replace(F.substring_index(value(s), "@", 1), "[^a-z]", "")),
        ("ip", "network", network),
        ("card", "issuer", lambda s: F.substring(digits(s), 1, 6)),
        ("phone", "area", lambda s: F.substring(digits(s), 1, 4)),
    ]

    def named(kind: str, level: str, of: Callable[[Column], Column]) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(level).alias("level"), of(s).alias("of")))

    return F.array_distinct(F.transform(F.filter(F.concat(*[named(*x) for x in levels]), lambda e: e["of"] != ""), lambda e: F.xxhash64(e["level"], e["of"])))


def _prose(text: Column) -> Column:
    """The text with addresses blanked; no other base span has a letter."""
    return sp.blanked(text, EMAIL, text.contains("@"))


def _words(text: Column) -> Column:
    """The different words of a text, lowered."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_prose(text), F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


def _standing(text: Column, words: Column) -> Column:
    """Every place of ``words`` (lowered) in a text: its spellings of them, between other characters than letters."""
    spelt = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.array_contains(words, F.lower(w)))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(spelt, "|"), F.lit(r")(?!\p{L})"))
    return F.transform(sp.find(text, pattern), lambda s: F.struct(s["start"], s["end"]))


def flagged_pairs(different: DataFrame, named: DataFrame, disclosure: float, support: int, of_pairs: bool = False) -> DataFrame:
    """(entity, word, n_et, bits, least): words that disclose an entity, by more ``bits`` than the ``least``.

    ``different`` has the different texts with entities (entities, words), ``named`` all texts. The least are the
    bits of choosing one of all words, or with ``of_pairs`` one of all pairs of word and entity.
    """
    texts = named.select("text").distinct()
    seen = different.select(F.explode("entities").alias("entity"), "words").select("entity", F.explode("words").alias("word"))
    pairs = seen.groupBy("entity", "word").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    of_entity = different.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    of_word = cut(texts.select(F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n_t")))
    hashes = named.select(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).distinct()  # to count texts without moving them
    n = hashes.agg(F.count("*").alias("n")).crossJoin(of_word.agg(F.log2(F.count("*")).alias("least")))  # one row
    if of_pairs:
        n = n.crossJoin(of_entity.agg(F.log2(F.count("*")).alias("more"))).select("n", (F.col("least") + F.col("more")).alias("least"))
    share, usual = F.col("n_et") / F.col("n_t"), F.col("n_e") / F.col("n")
    rest = F.when(share < 1, (1 - share) * F.log2((1 - share) / (1 - usual))).otherwise(0.0)
    return (
        pairs.join(of_entity, "entity")
        .join(of_word, "word")
        .crossJoin(F.broadcast(n))  # one row
        .withColumn("bits", F.col("n_t") * (share * F.log2(share / usual) + rest))
        .where((F.col("n_e") < F.col("n")) & (F.log2(share / usual) >= -disclosure * F.log2(usual)) & (F.col("bits") > F.col("least")))
        .select("entity", "word", "n_et", "bits", "least")
    )


def _beside(many: DataFrame, salt_of: str, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``many`` rows a key with one row a key; a hot key's rows are dealt out by a hash they hold."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(salt_of, F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def independent_pairs(flagged: DataFrame, places: DataFrame, different: DataFrame, alike: float, support: int) -> DataFrame:
    """(entity, word): the flagged pairs that hold when texts alike are one piece of evidence.

    ``places`` has the texts of each flagged pair (said, said2, entity, word).
    """
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    of_text = different.select("said", "said2", hashes.alias("own"))
    left = places
    for _ in range(support - 1):
        leads = left.groupBy("entity", "word").agg(F.min(F.struct("said", "said2")).alias("lead"))
        led = cut(_beside(left, "said", leads.select("entity", "word", F.col("lead.said").alias("lead"), F.col("lead.said2").alias("lead2")), ["entity", "word"]))
        # each text meets each of its leaders once, whatever the number of their words
        pairs = led.select("said", "said2", "lead", "lead2").distinct()
        leading = of_text.select(F.col("said").alias("lead"), F.col("said2").alias("lead2"), F.col("own").alias("theirs"))
        leading = leading.join(led.select("lead", "lead2").distinct(), ["lead", "lead2"], "left_semi")
        both = _beside(pairs.join(of_text, ["said", "said2"]), "said", leading, ["lead", "lead2"])
        common = F.size(F.array_intersect("own", "theirs"))
        apart = both.where(common < alike * (F.size("own") + F.size("theirs") - common)).select("said", "said2", "lead", "lead2")
        left = led.join(apart, ["said", "said2", "lead", "lead2"], "left_semi").select("said", "said2", "entity", "word")
    rest = left.groupBy("entity", "word").agg(F.count("*").alias("rest"))
    evidence = F.col("rest") + (support - 1)
    return flagged.join(rest, ["entity", "word"]).where(F.col("bits") * evidence / F.col("n_et") > F.col("least")).select("entity", "word")


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, alike: float | None = None) -> DataFrame:
    """(k, uid, terms array<struct<start,end>>): words that disclose an entity of their text, wherever they stand in it.

    Terms overlap no base span. Null and empty texts have none; rows that repeat have one row here. With ``alike``
    near copies are one piece of evidence; a flagged word is a term in each of them all the same.
    """
    named = ex.named(docs)
    rows = _with_base(named).where(F.size(F.concat(*KINDS)) > 0)
    # texts with an entity only; two hashes name a text
    said = [F.xxhash64("text").alias("said"), F.xxhash64(F.lit(1), "text").alias("said2")]
    holding = cut(rows.select("k", "uid", "text", *said, _entities().alias("entities")))
    once = holding.select("said", "said2", "entities", "text").dropDuplicates(["said", "said2"])
    different = cut(once.select("said", "said2", "entities", _words(F.col("text")).alias("words")))
    flagged = flagged_pairs(different, named, disclosure, support, of_pairs=alike is not None)
    seen = different.select("said", "said2", "words", F.explode("entities").alias("entity")).select("said", "said2", "entity", F.explode("words").alias("word"))
    if alike is None:
        told = _beside(seen, "said", flagged.select("entity", "word"), ["entity", "word"])
    else:
        flagged = cut(flagged)
        pairs = flagged.select("entity", "word")
        few = flagged.count() <= BROADCAST_ROWS
        places = cut(seen.join(F.broadcast(pairs), ["entity", "word"]) if few else _beside(seen, "said", pairs, ["entity", "word"]))
        told = _beside(places, "said", independent_pairs(flagged, places, different, alike, support), ["entity", "word"])
    told = told.groupBy("said", "said2").agg(F.collect_set("word").alias("words"))  # a text's words at most
    return holding.join(told, ["said", "said2"]).select("k", "uid", _standing(_prose(F.col("text")), F.col("words")).alias("terms")).dropDuplicates(["k", "uid"])


NO_TERMS = "array<struct<start:int,end:int>>"


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, alike: float | None = None) -> DataFrame:
    """Spans of personal data in every text.

    Returned, a row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the
    base spans ``kind:start:end`` by kind, then start, comma-joined), spans (all spans, joined likewise,
    kind ``term`` last) and n_term. Offsets are code points, end exclusive.

    Null texts are empty; empty texts have no spans. Words count once for each text that shows them with an
    entity, so copies are no evidence, nor with ``alike`` near copies. Rows with equal id and text have equal results; null ids are kept.
    Other columns are ignored.
    """
    base = _with_base(ex.named(docs)).select(
        "doc_id",
        "k",
        "uid",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.concat(*[_listed(kind, F.col(kind)) for kind in KINDS]).alias("listed"),
    )
    terms = disclosing_terms(docs, disclosure, support, alike)
    kept = base.join(terms, ["k", "uid"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(NO_TERMS)))
    return kept.select(
        "doc_id",
        *[f"n_{kind}" for kind in KINDS],
        F.sha2(F.array_join("listed", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("listed", _listed("term", F.col("terms"))), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def _generalised(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], F.lit(f"[{kind.upper()}]").alias("put")))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, alike: float | None = None) -> DataFrame:
    """The rows of ``docs`` with base spans of ``text`` generalised to ``[KIND]`` and disclosing terms removed.

    Null texts stay null; all other columns stay as they are. Where base spans of two kinds overlap, one
    placeholder (of the first kind by start) stands for both.
    """
    k, uid, text, base, found_terms = ex.free(docs, "k", "uid", "whole", "base", "terms")
    rows = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), F.lit(ex.LAST)), text: F.coalesce("text", F.lit(""))})
    rows = rows.withColumn(uid, ex.uid_of(F.col(k), F.col(text)))
    found = base_spans(F.col(text))
    rows = rows.withColumn(base, F.concat(*[_generalised(kind, found[kind]) for kind in KINDS]))
    terms = disclosing_terms(docs, disclosure, support, alike).select(F.col("k").alias(k), F.col("uid").alias(uid), F.col("terms").alias(found_terms))
    rows = rows.join(terms, [k, uid], "left")
    removed = F.transform(F.coalesce(found_terms, F.array().cast(NO_TERMS)), lambda t: F.struct(t["start"], t["end"], F.lit("").alias("put")))
    clean = F.when(F.col("text").isNull(), F.col("text")).otherwise(sp.replaced(F.col(text), F.array_sort(F.concat(base, removed))))
    return rows.select(*[clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
