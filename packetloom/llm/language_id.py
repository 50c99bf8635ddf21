"""Language identification by Bayesian fusion of text likelihoods, the declared language, the address suffix and host priors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, per_task, texts, written

BUCKETS = 1 << 14
#: Trigrams of a text that are made at once.
SEGMENT = 1 << 18
#: Documents of each language that the text model is fitted on, about, where there are more; those with the lowest hashes of doc_id.
FIT_DOCS = 3000
#: Trigrams count as independent up to this number; more of them add no certainty.
EFFECTIVE = 60
#: How often a declared language, or one named by a suffix, is the true one.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.85, 0.6
#: Rows that a host's, domain's parent counts for.
SMOOTHING = 20.0
LEAST_POSTERIOR = 0.5
#: Address suffixes that speak for a language. Fixed values.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en"}

_FOLD = np.full(256, 32, np.int64)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _padded(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)


def _buckets(raw: np.ndarray) -> np.ndarray:
    x = _FOLD[raw]
    a, b, c = x[:-2], x[1:-1], x[2:]
    return ((a * 961 + b * 31 + c) * 2654435761 >> 7 & (BUCKETS - 1))[(b != 32) | ((a != 32) & (c != 32))]


def trigrams(text: str) -> np.ndarray:
    """Buckets of a text's byte trigrams; all that is no letter counts as blank, and trigrams of blanks alone are left out."""
    return _buckets(_padded(text))


def trigram_counts(text: str) -> np.ndarray:
    """How often each bucket comes among trigrams(text), which are made in segments, so that a long text asks for little memory beside its own."""
    raw, out = _padded(text), np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw) - 2, SEGMENT):
        out += np.bincount(_buckets(raw[at : at + SEGMENT + 2]), minlength=BUCKETS)
    return out


class TextModel:
    """Log probabilities by (bucket, language), and the mean per trigram below which a text is in none of the languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=0)
        p = counts + 0.5 * total / max(1.0, total.max(initial=0.0))  # an unseen trigram is as likely in a rare language as in a common one
        p = p / p.sum(axis=0)
        self.log_p = np.log(p).astype(np.float32)
        own = (p * np.log(p)).sum(axis=0)
        self.floor = float(own.min() * 0.4 + np.log(1 / BUCKETS) * 0.6 - 1.0) if languages else 0.0

    def score(self, text: str) -> tuple[list[float], int, bool]:
        """Log likelihoods, number of trigrams, and whether any language fits."""
        if len(text) > SEGMENT:
            counts = trigram_counts(text)
            n, total = int(counts.sum()), counts @ self.log_p.astype(np.float64)
        else:
            ids = trigrams(text)
            n, total = len(ids), self.log_p[ids].sum(axis=0, dtype=np.float64)
        if not n or not self.languages:
            return [0.0] * len(self.languages), n, False
        mean = total / n
        return (mean * min(n, EFFECTIVE)).tolist(), n, bool(n < 20 or mean.max() >= self.floor)


def fit_text_model(labelled: DataFrame, most: int = FIT_DOCS) -> TextModel:
    """labelled: doc_id, text, declared. Every declared language with letters in its texts is one of the model, however rare: they are counted over all rows, and each has a
    sample of its own. Counts come summed from the executors; only (bucket, language) sums reach the driver."""
    known = labelled.where(F.col("declared").isNotNull())
    shares = written(known.groupBy("declared").agg((F.lit(float(most)) / F.count(F.lit(1))).alias("share")), "languages")
    place = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = written(known.join(F.broadcast(shares), "declared").where(place < F.col("share")).select("doc_id", "text", "declared").repartition(8), "language-sample")

    def count(batches):
        by: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts(batch), texts(batch, "declared")):
                by.setdefault(lang, np.zeros(BUCKETS, np.int64))
                by[lang] += trigram_counts(text)
        for lang, v in by.items():
            used = np.flatnonzero(v)
            if len(used):
                yield {"declared": [lang] * len(used), "bucket": used, "n": v[used]}

    got = per_task(sample, count, "declared string, bucket long, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    languages = sorted(set(got["declared"]))
    counts, place = np.zeros((BUCKETS, len(languages))), {k: i for i, k in enumerate(languages)}
    for lang, bucket, n in zip(got["declared"], got["bucket"], got["n"]):
        counts[bucket, place[lang]] = n
    return TextModel(languages, counts)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def identify(items: DataFrame, model: TextModel) -> DataFrame:
    """items: id, text, declared, suffix, host, domain. Returns id, language, posterior, text_language, n_trigrams, accepted.

    Host priors are means of text posteriors over all rows of the host, drawn towards those of its domain, and these towards the overall ones.
    Null declared, suffix or host adds nothing. A text without letters has language null and is not accepted, as is one that fits no language
    or whose best posterior is below LEAST_POSTERIOR. Ties go to the language first in the alphabet."""
    langs = model.languages
    if not langs:
        return items.select("id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("accepted"))

    def likelihoods(batch: pa.RecordBatch) -> dict:
        lp, n, fits = zip(*(model.score(t) for t in texts(batch)))
        p = [_softmax(np.array(x)).tolist() for x in lp]
        return {c: batch.column(batch.schema.get_field_index(c)) for c in ("id", "declared", "suffix", "host", "domain")} | {"lp": list(lp), "p": p, "n": list(n), "fits": list(fits)}

    scored = in_batches(items.select("id", "text", "declared", "suffix", "host", "domain"), likelihoods, "id long, declared string, suffix string, host string, domain string, lp array<double>, p array<double>, n long, fits boolean")
    scored = written(scored, "likelihoods")
    sums = [F.round(F.sum(F.when(F.col("n") > 0, F.col("p")[i])), 6).alias(f"s{i}") for i in range(len(langs))]
    hosts = written(scored.where(F.col("host").isNotNull() & F.col("fits")).groupBy("host", "domain").agg(F.count_if(F.col("n") > 0).alias("rows"), *sums), "hosts")

    def prior(own: str, parent: Column) -> Column:
        k = F.lit(SMOOTHING)
        return F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: (F.coalesce(F.get(F.col(own), i), F.lit(0.0)) + k * F.get(parent, i)) / (F.coalesce(F.col(f"{own}_rows"), F.lit(0)) + k))

    totals = hosts.agg(F.sum("rows").alias("rows"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(langs))]).first()
    top = F.array(*[F.lit(((totals[i + 1] or 0.0) + 1) / ((totals["rows"] or 0) + len(langs))) for i in range(len(langs))])
    domains = written(hosts.groupBy("domain").agg(F.sum("rows").alias("d_rows"), F.array(*[F.sum(f"s{i}") for i in range(len(langs))]).alias("d")).select("domain", prior("d", top).alias("domain_prior")), "domains")
    table = hosts.select("host", "domain", F.col("rows").alias("h_rows"), F.array(*[f"s{i}" for i in range(len(langs))]).alias("h")).join(domains, "domain")
    table = written(table.select("host", "domain", prior("h", F.col("domain_prior")).alias("prior")), "host-priors")
    joined = scored.join(table, ["host", "domain"], "left").select("id", "declared", "suffix", "lp", "n", "fits", F.coalesce("prior", top).alias("prior"))
    place = {k: i for i, k in enumerate(langs)}

    def says(lang: str | None, right: float) -> np.ndarray | float:
        if lang not in place or len(langs) < 2:
            return 0.0
        out = np.full(len(langs), math.log((1 - right) / (len(langs) - 1)))
        out[place[lang]] = math.log(right)
        return out

    declared_says, suffix_says = {k: says(k, DECLARED_RIGHT) for k in langs}, {k: says(v, SUFFIX_RIGHT) for k, v in SUFFIXES.items()}

    def fuse(batch: pa.RecordBatch) -> dict:
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("declared", "suffix", "n", "fits")}
        lp = np.array(batch.column(batch.schema.get_field_index("lp")).to_pylist())
        log_prior = np.log(np.array(batch.column(batch.schema.get_field_index("prior")).to_pylist()))
        extra = np.array([declared_says.get(d, 0.0) + suffix_says.get(s, 0.0) + np.zeros(len(langs)) for d, s in zip(cols["declared"].to_pylist(), cols["suffix"].to_pylist())])
        post = np.apply_along_axis(_softmax, 1, lp + log_prior + extra)
        best, n = post.argmax(axis=1), np.array(cols["n"].to_pylist())
        top_p, fits = post.max(axis=1), np.array(cols["fits"].to_pylist(), bool)
        return {"id": batch.column(0), "language": [langs[i] if k else None for i, k in zip(best, n)], "posterior": np.where(n > 0, np.round(top_p, 6), 0.0), "text_language": [langs[i] if k else None for i, k in zip(lp.argmax(axis=1), n)], "n_trigrams": n, "accepted": (n > 0) & fits & (top_p >= LEAST_POSTERIOR)}

    return in_batches(joined, fuse, "id long, language string, posterior double, text_language string, n_trigrams long, accepted boolean")


def of_documents(docs: DataFrame) -> DataFrame:
    """documents as items: lang is what was declared, source is the host, and its name without digits the domain."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.regexp_replace("source", "[0-9]+$", "").alias("domain"))


def of_pages(pages: DataFrame) -> DataFrame:
    """pages as items: the lang attribute, the address's last label, host and the host's last two labels."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^<>]*>", " ")
    return pages.select(F.col("page_id").alias("id"), bare.alias("text"), F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^<>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit("")).alias("declared"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), F.nullif(host, F.lit("")).alias("host"), F.array_join(F.slice(F.reverse(F.split(host, r"\.")), 1, 2), ".").alias("domain"))


def op5_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, language, posterior, text_language, n_trigrams, accepted of every document."""
    items = of_documents(docs)
    return identify(items, fit_text_model(items.select(F.col("id").alias("doc_id"), "text", "declared"))).withColumnRenamed("id", "doc_id")


def op5_pages(pages: DataFrame) -> DataFrame:
    """The same of every page, with the text model fitted on pages that declare a language."""
    items = of_pages(pages)
    return identify(items, fit_text_model(items.select(F.col("id").alias("doc_id"), "text", "declared"))).withColumnRenamed("id", "page_id")
