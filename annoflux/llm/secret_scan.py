"""Secrets in texts and who else has them, by built-in functions only.

Candidates are assigned passwords and tokens, access keys, hexadecimal runs and, as
the method's own kind, long mixed-case keys. The hash of each candidate's value is
counted over the corpus by distinct repositories and owners: a value in ``widely``
repositories or more is a copied example; one that a single owner has, with enough
different characters, looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoflux.llm import exchange as ex
from annoflux.llm import spans as sp
from annoflux.llm.storage import cut

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?+ *+[:=] *+["']?+[A-Za-z0-9+/_.=-]++"""
_NAME = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?+ *+[:=] *+["']?+"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
#: The method's own candidates: long runs with upper and lower case letters and digits.
MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+"
#: Repositories from which a value counts as a copied example, and different characters of a live one.
WIDELY = 3
DIFFERENT = 8
#: Parts into which a value's rows are dealt when its counts come back to them.
SALTS = 16


def _candidates(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, value) by kind; value is the secret itself."""
    assign = F.transform(
        sp.find(text, ASSIGN, text.rlike(r"[:=]")),
        lambda s: F.struct(s["start"], s["end"], F.regexp_replace(s["value"], _NAME, "").alias("value")),
    )
    return {
        "assign": F.filter(assign, lambda s: F.length(s["value"]) >= 12),
        "access": F.filter(sp.find(text, ACCESS, text.contains("AKIA")), lambda s: F.length(s["value"]) >= 18),
        "hex": sp.find(text, HEX),
        "mixed": F.filter(
            sp.find(text, MIXED), lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]")
        ),
    }


def _described(rank: int, kind: str, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"],
            F.lit(rank).alias("rank"),
            s["end"],
            F.lit(kind).alias("kind"),
            F.sha2(s["value"], 256).alias("value"),
            F.size(F.array_distinct(F.split(s["value"], ""))).alias("different"),
        ),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("c", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def scan(docs: DataFrame, repository: str = "source", owner: str | None = None, widely: int = WIDELY, different: int = DIFFERENT) -> DataFrame:
    """Secrets of every text with their spread.

    ``repository`` and ``owner`` name columns; without an owner the repository is the owner. Returned, a row
    for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 (of ``kind:start:end`` by start,
    then kind, comma-joined), spans (base spans and those of kind ``mixed`` that look live, joined likewise),
    n_live, n_example and candidates (kind, start, end, hash of the value, n_repositories, n_owners, verdict).

    Null texts are empty; empty texts have no spans. A null repository or owner counts as one of its own.
    Rows with equal id and text have equal results; null ids are kept. Other columns are ignored.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner or repository).cast("string"), F.lit("")).alias("owner"),
    ).withColumns({"k": F.coalesce("doc_id", F.lit(ex.LAST)), "said": F.xxhash64("text")})
    found = _candidates(F.col("text"))
    # texts are searched once; what is kept is a row's candidates
    rows = cut(named.select("doc_id", "k", "said", "repository", "owner", F.concat(*[_described(i, kind, c) for i, (kind, c) in enumerate(found.items())]).alias("c")))
    each = rows.select("k", "said", "repository", "owner", F.explode("c").alias("c"))
    spread = (
        each.select(F.col("c.value").alias("value"), "repository", "owner")
        .distinct()
        .groupBy("value")
        .agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
    )
    salted = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = (
        each.select("k", "said", F.pmod(F.xxhash64("k", "said"), F.lit(SALTS)).cast("int").alias("salt"), F.col("c.*"))
        .distinct()
        .join(salted, ["value", "salt"])
        .withColumn(
            "verdict",
            F.when(F.col("n_repositories") >= widely, "example")
            .when((F.col("n_owners") == 1) & (F.col("different") >= different), "live")
            .otherwise("unclear"),
        )
        .groupBy("k", "said")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "value", "n_repositories", "n_owners", "verdict"))).alias("candidates"))
    )
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,n_repositories:bigint,n_owners:bigint,verdict:string>>")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = rows.select(
        "doc_id", "k", "said",
        *[_count(kind) for kind in KINDS],
        F.sha2(listed(F.array_sort(F.filter("c", lambda s: s["kind"] != "mixed"))), 256).alias("base_sha256"),
    )
    return (
        base.join(judged, ["k", "said"], "left")
        .withColumn("candidates", F.coalesce("candidates", empty))
        .select(
            "doc_id",
            *[f"n_{kind}" for kind in KINDS],
            "base_sha256",
            listed(F.filter("candidates", lambda s: (s["kind"] != "mixed") | (s["verdict"] == "live"))).alias("spans"),
            F.size(F.filter("candidates", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
            F.size(F.filter("candidates", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
            "candidates",
        )
    )
