"""Language identification by Bayesian fusion of evidence.

* **Text.** Hashed byte trigrams under one multinomial a language. Every
  language that any row declares has a table, fitted on about ``SAMPLE`` of
  its rows, chosen by a hash (the bound is a parameter), or on all where it
  has fewer; the likelihood of a whole text is tempered to that of
  ``EFFECTIVE`` independent trigrams, since neighbours overlap. Each table is
  mixed with ``UNSEEN`` of the uniform one, so an unseen trigram costs every
  language the same, however much text it was fitted on.
* **Unknown class.** The uniform table alone: text of no modelled language has
  too many trigrams that none of them has seen. Its prior is ``UNKNOWN_PRIOR``
  at least, at any host, so it doesn't fade as a table or a host grows.
* **Declared language** (markup attribute or metadata) and **address suffix**:
  P(value | language) from grouped sums of the text posteriors of all rows.
* **Host prior**: P(language | host) from the same sums, smoothed towards the
  host's suffix and that towards all rows (Dirichlet, ``STRENGTH`` rows each); a row's
  own vote is taken out of its host's counts.

Text scores are one narrow pass; the sums are partial aggregates with one row
per value, so a host with a third of all rows is one row too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import Scratch, packed, unpacked

SAMPLE, SLOTS, EFFECTIVE, STRENGTH = 4000, 1 << 15, 60.0, 20.0
UNSEEN, UNKNOWN_PRIOR = 0.01, 0.01
NEW = ["language", "posterior", "rejected"]
UNKNOWN = "und"
#: Subtags that are no language: undetermined, several, uncoded, no linguistic content.
NO_LANGUAGE = ["und", "mul", "mis", "zxx"]


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    weights: bytes  # float32, SLOTS x (languages, unknown): log P(slot | class)


def trigram_slots(text: bytes):
    """Hashed trigrams of the lower-cased text, framed by spaces; runs of other bytes than letters are one space."""
    import re

    import numpy as np

    b = np.frombuffer(b" " + re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.lower()) + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * 961 + b[1:-1]) * 31 + b[2:]) * np.uint32(2654435761) >> np.uint32(32 - 15) if len(b) > 2 else np.zeros(0, np.uint32)


def letters(text: bytes) -> int:
    import re

    return len(re.findall(rb"[A-Za-z\xc3-\xf4]", text[: 1 << 16])) or len(re.findall(rb"[A-Za-z\xc3-\xf4]", text))


def fit(docs: DataFrame, text: str, declared: str, doc_id: str, sample: int = SAMPLE) -> TextModel:
    """Trigram tables of all declared languages, each from about ``sample`` of its rows, or all if it has fewer. No declared row: a model without languages, which rejects all.

    One pass counts the rows of each language (a partial aggregate), a second
    reads the chosen ones. Rows without a letter don't count. A table has
    ``SLOTS`` floats (128 KB) a language, on the driver and in each worker.
    """
    import numpy as np

    place = F.shiftrightunsigned(F.xxhash64(F.lit("language"), F.col(doc_id), F.col(text)), 1)
    labelled = (docs.select(primary_subtag(F.col(declared)).alias("lang"), place.alias("place"), F.col(text).alias("text"))
                .where((F.col("lang") != "") & ~F.col("lang").isin(NO_LANGUAGE) & F.col("text").rlike(r"[A-Za-z\x{C0}-\x{10FFFF}]")))
    # up to its first place, so that a language of equal rows has some too
    last = {r["lang"]: max(r["least"], min((1 << 63) - 1, (sample << 63) // r["n"]))
            for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")).collect()}
    languages = sorted(last)
    if not languages:
        return TextModel([], b"")
    at_most = F.element_at(F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(last[lang]).cast("long"))]), F.col("lang"))
    index = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sums: dict = {}
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigram_slots(t.encode()), minlength=SLOTS)
            for lang, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([index[lang]] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "slot", "n"])

    rows = labelled.where(F.col("place") <= at_most).select("lang", "text").mapInArrow(count, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((SLOTS, len(languages)))
    table[rows["slot"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    mixed = (1 - UNSEEN) * table / table.sum(0) + UNSEEN / SLOTS
    return TextModel(languages, np.log(np.c_[mixed, np.full(SLOTS, 1 / SLOTS)]).astype(np.float32).tobytes())


def primary_subtag(value: Column) -> Column:
    """``en-GB`` -> ``en``; what is no tag is empty."""
    return F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))


def _scores(df: DataFrame, model: TextModel) -> DataFrame:
    """+ ``_logits`` (tempered log likelihoods) and ``_letters`` for column ``_text``, which goes."""
    n = len(model.languages) + 1
    kept = [f for f in df.schema.fields if f.name != "_text"]
    schema = T.StructType([*kept, T.StructField("_logits", T.ArrayType(T.DoubleType())), T.StructField("_letters", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        weights = np.frombuffer(model.weights, np.float32).reshape(SLOTS, n)
        for batch in batches:
            logits, seen = [], []
            for t in batch.column(batch.schema.get_field_index("_text")):
                body = (t.as_py() or "").encode()
                slots = trigram_slots(body)
                total = sum((weights[slots[i:i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(slots), 65536)), np.zeros(n))
                logits.append((total * min(1.0, EFFECTIVE / max(1, len(slots)))).tolist())
                seen.append(letters(body))
            rest = batch.select([f.name for f in kept])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(logits, pa.list_(pa.float64())), pa.array(seen, pa.int64())], schema.names)

    return df.mapInArrow(run, schema)


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, not once for each element of an array that uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _softmax(logits: Column) -> Column:
    over_sum = lambda raised: _once(F.aggregate(raised, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(raised, lambda x: x / total))
    return _once(logits, lambda x: _once(F.array_max(x), lambda top: _once(F.transform(x, lambda y: F.exp(y - top)), over_sum)))


def identify(df: DataFrame, model: TextModel, text: str, declared: str | None = None, host: str | None = None, suffix: str | None = None,
             least_posterior: float = 0.5, keep_columns: list[str] | None = None) -> DataFrame:
    """The input columns with ``language``, ``posterior`` and ``rejected``, one row per input row.

    Any of the evidence columns may be absent or null: that evidence is then
    neutral. A text without a letter (null, empty, only digits or signs) is
    ``und`` and rejected, as is one whose best class is the unknown one (its
    posterior is given then) or whose best posterior is under
    ``least_posterior``; texts of any length are read whole. Ties between
    languages go to the first by name. Repeated rows are each identified; an
    empty table gives an empty result. An input column named like a new one
    gives way to it.
    """
    columns, n = df.columns if keep_columns is None else keep_columns, len(model.languages) + 1  # the unknown class is the last
    scratch = Scratch(df.sparkSession, "language")
    null = F.lit(None).cast("string")
    given = df.select(packed(df, columns).alias("_row"), F.col(text).alias("_text"),
                      (F.nullif(primary_subtag(F.col(declared)), F.lit("")) if declared else null).alias("_declared"),
                      (F.col(host).cast("string") if host else null).alias("_host"), (F.col(suffix).cast("string") if suffix else null).alias("_suffix"))
    if n == 1:
        return given.select(*unpacked("_row", columns, NEW), F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("rejected"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.array(*[F.lit(math.log((1 - UNKNOWN_PRIOR) / (n - 1)))] * (n - 1), F.lit(math.log(UNKNOWN_PRIOR)))
    rows = _scores(given, model).withColumn("_own", F.when(F.col("_letters") > 0, _softmax(add(F.col("_logits"), prior))).otherwise(F.array(*[F.lit(0.0)] * n)))
    rows = scratch.table(rows, "scores")

    votes = [F.sum(F.element_at("_own", i + 1)).alias(f"v{i}") for i in range(n)]
    array = lambda prefix: F.array(*[F.col(f"{prefix}{i}") for i in range(n)])
    total = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x)
    everything = rows.agg(*votes).select(F.transform(array("v"), lambda x: F.coalesce(x, F.lit(0.0))).alias("all")).first()["all"]
    size = sum(everything)
    base = [(v + 1.0) / (size + n) for v in everything]  # P(language)

    def likelihood(column: str, name: str) -> DataFrame:
        """log P(value | language) for each value, smoothed by the value's share of all rows."""
        sums = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"{name}_value")).agg(*votes).select(f"{name}_value", array("v").alias("_votes"))
        share = sums.withColumn("_share", (total + 1) / F.lit(size + 1))
        parts = F.zip_with("_votes", F.array(*[F.lit(v + STRENGTH) for v in everything]), lambda v, all_of: F.log((v + STRENGTH * F.col("_share")) / all_of))
        return scratch.table(share.select(f"{name}_value", parts.alias(name)), name)

    by_suffix = likelihood("_suffix", "ev_suffix")
    by_declared = likelihood("_declared", "ev_declared")
    above = rows.where(F.col("_suffix").isNotNull()).groupBy(F.col("_suffix").alias("_s")).agg(*votes).select("_s", array("v").alias("_votes")).withColumn("_total", total + STRENGTH)
    above = scratch.table(above.select("_s", F.zip_with("_votes", F.array(*[F.lit(b) for b in base]), lambda v, p: (v + STRENGTH * p) / F.col("_total")).alias("_above")), "above")
    hosts = scratch.table(rows.where(F.col("_host").isNotNull()).groupBy(F.col("_host").alias("_h")).agg(*votes).select("_h", array("v").alias("_votes")), "hosts")

    known = (rows.join(by_suffix, F.col("_suffix") == F.col("ev_suffix_value"), "left").join(by_declared, F.col("_declared") == F.col("ev_declared_value"), "left")
             .join(above, F.col("_suffix") == F.col("_s"), "left").join(hosts, F.col("_host") == F.col("_h"), "left"))
    zeros = F.array(*[F.lit(0.0)] * n)
    level = F.coalesce("_above", F.array(*[F.lit(b) for b in base]))
    others = F.when(F.col("_votes").isNull(), zeros).otherwise(F.zip_with("_votes", "_own", lambda v, own: F.greatest(v - own, F.lit(0.0))))
    # the common divisor cancels; the unknown class has its prior's share of the whole at least
    known_part = lambda w: F.aggregate(F.slice(w, 1, n - 1), F.lit(0.0), lambda a, x: a + x)
    smoothed = _once(F.zip_with(others, level, lambda v, p: v + STRENGTH * p), lambda w: _once(
        known_part(w) * (UNKNOWN_PRIOR / (1 - UNKNOWN_PRIOR)), lambda least: F.transform(w, lambda x, i: F.log(F.when(i == n - 1, F.greatest(x, least)).otherwise(x)))))
    # the suffix counts in the prior when there is a host, else as a likelihood of its own
    suffix_term = F.when(F.col("_host").isNull(), F.coalesce("ev_suffix", zeros)).otherwise(zeros)
    fused = known.withColumn("_post", _softmax(add(add(add(F.col("_logits"), F.coalesce("ev_declared", zeros)), suffix_term), smoothed)))
    best = F.array_max("_post")
    fused = fused.select("_row", "_letters", best.alias("posterior"), F.element_at(F.array(*[F.lit(x) for x in [*model.languages, UNKNOWN]]), F.array_position("_post", best).cast("int")).alias("_best"))
    rejected = (F.col("_letters") == 0) | (F.col("_best") == UNKNOWN) | (F.col("posterior") < least_posterior)
    return fused.select(*unpacked("_row", columns, NEW), F.when(rejected, UNKNOWN).otherwise(F.col("_best")).alias("language"), "posterior", rejected.alias("rejected"))


def page_evidence(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with ``_body`` (markup removed), ``_markup`` (declared language), ``_site`` (host) and ``_tld`` (address suffix)."""
    body = F.col(html)
    for pattern in (r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        body = F.regexp_replace(body, pattern, " ")
    site = F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return pages.select("*", body.alias("_body"), F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("_markup"),
                        site.alias("_site"), F.nullif(F.regexp_extract(F.coalesce(site, F.lit("")), r"\.([a-z0-9-]+)\.?$", 1), F.lit("")).alias("_tld"))
