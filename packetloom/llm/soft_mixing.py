"""Mixing sources to target weights: soft membership. DataFrame operations and Spark ML only.

A classifier trained on labelled rows (a sample of at most `max_labelled`, by hash of doc_id) gives every
document a posterior over domains from hashed words of its whole text. With tokens n_i (words) and posteriors
p_id, distributed projected gradient finds nonnegative rates r_i whose expected domain totals
sum_i r_i n_i p_id match the targets in least squares: each step sums K numbers over all documents, and a
rate is a closed expression of the K residuals of each step. Totals are weighted by 1/S_d (S_d: the
domain's expected tokens before mixing) and rates by n_i, where a step of length one is safe. The budget is the
least at which no domain must shrink; a common scale of at most `lift` then brings the least rate to one, so that documents are
thinned out only where the exact solution asks for rates below 1 / `lift` of the scale. Rates become whole copies, the
fraction by a hash of the document, at least `fewest` of each. Nothing else bounds rates by default. Two options leave the
exact solution on purpose: `most`, before the scale, stops a domain too rare for its target at so many copies, and `fewest`
= 1 keeps every document. `steps` bounds the descent: a domain of a hundredth of the tokens that is to give nine tenths ends
within half a hundredth of its share. `totals` shows what is met.

Null and empty texts have no tokens; they get a posterior (the classifier's intercept) and a rate like any
other. Null domains or ids are not learned from. A labelled domain without a target (or with nought) has its own tokens before
mixing as its target, so its documents stay; targets without a labelled domain are left out and the others scaled up. Without
labels, or with one domain, all rates are 1. Repeated rows are documents of their own and get equal rates. Columns besides doc_id, text
and the domain's are kept by `mix`, whatever their names, and ignored by `rates`. No documents give no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import stash, table

TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def vectorised(docs: DataFrame, buckets: int) -> DataFrame:
    """docs with _words and _v, the hashed words of length one."""
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=buckets)
    return Normalizer(inputCol="_tf", outputCol="_v").transform(tf.transform(docs.withColumn("_words", words(F.col("text"))))).drop("_tf")


class Mixer:
    """A fitted classifier with the residuals that make rates."""

    def __init__(self, docs: DataFrame, labels: DataFrame, domain: str, targets: dict[str, float], max_labelled: int = 2000, buckets: int = 1024, steps: int = 25, tolerance: float = 1e-3, most: float | None = None, lift: float = 2.0, key: Column | None = None):
        self.buckets, self.model, self.domains, self.residuals, self.scale, self.most, self.lift = buckets, None, [], [], 1.0, most, lift
        own = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        learn = docs.select("doc_id", "text", F.col(domain).alias("_domain")).where("_domain IS NOT NULL").join(F.broadcast(own), "doc_id")
        learn = stash(learn, "mix-sample")
        self.domains = sorted(r[0] for r in learn.select("_domain").distinct().collect())
        if len(self.domains) > 1:
            number = F.array_position(F.array(*map(F.lit, self.domains)), F.col("_domain")) - 1
            train = vectorised(learn, buckets).select("_v", number.cast("double").alias("_y"))
            self.model = LogisticRegression(featuresCol="_v", labelCol="_y", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_class", family="multinomial", maxIter=30, regParam=1e-4, standardization=False).fit(train)
        # tokens and posteriors of all documents, computed once; with a key, the rows that `rates` returns
        made = self.posteriors(docs.select("doc_id", "text"))
        self.held = stash(made.select("_n", "_p", *([] if key is None else ["doc_id", key.alias("_key")])), "mix-posteriors")
        if self.domains:
            self._fit(targets, steps, tolerance)

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """docs with _n (tokens) and _p (array of double, by domain)."""
        if self.model is None:
            return docs.withColumn("_n", F.size(words(F.col("text"))).cast("long")).withColumn("_p", F.array(*[F.lit(1.0) for _ in self.domains]).cast("array<double>"))
        out = self.model.transform(vectorised(docs, self.buckets)).withColumn("_n", F.size("_words").cast("long"))
        return out.withColumn("_p", vector_to_array("_p")).drop("_words", "_v", "_raw", "_class")

    def rate(self, p: str = "_p") -> Column:
        """The rate from posteriors p: the steps of projected gradient, from the residuals over S of each."""
        if not self.residuals:
            return F.lit(1.0)
        steps = F.array(*[F.array(*map(F.lit, r)) for r in self.residuals])
        dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        top = (lambda r: r) if self.most is None else lambda r: F.least(F.lit(float(self.most)), r)
        return F.aggregate(steps, F.lit(1.0), lambda r, g: top(F.greatest(F.lit(0.0), r - dot(g)))) * F.lit(self.scale)

    def _totals(self, held: DataFrame) -> list[float]:
        sums = held.agg(*[F.sum(F.col("_r") * F.col("_n") * F.col("_p")[k]).alias(f"s{k}") for k in range(len(self.domains))]).first()
        return [s or 0.0 for s in sums]

    def _fit(self, targets: dict[str, float], steps: int, tolerance: float) -> None:
        held = self.held
        self.before = self._totals(held.withColumn("_r", F.lit(1.0)))
        known = [max(0.0, targets.get(d, 0.0)) for d in self.domains]
        if not sum(known) or not all(s > 0 for s, w in zip(self.before, known, strict=True) if w):
            return
        budget = max(s / w for s, w in zip(self.before, known, strict=True) if w)
        self.targets = [budget * w if w else s for s, w in zip(self.before, known, strict=True)]
        for _ in range(steps):
            now = self._totals(held.withColumn("_r", self.rate()))
            gap = [(a - t) / max(s, 1e-9) for a, t, s in zip(now, self.targets, self.before, strict=True)]
            if max(map(abs, gap)) <= tolerance:
                break
            self.residuals.append(gap)
        least = held.agg(F.min(self.rate())).first()[0]
        if least is not None and least < 1:
            self.scale = min(self.lift, 1 / least) if least else self.lift
            self.targets = [t * self.scale for t in self.targets]


    def totals(self) -> list[tuple[str, float, float]]:
        """Domain, expected tokens after mixing, target."""
        return list(zip(self.domains, self._totals(self.held.withColumn("_r", self.rate())), getattr(self, "targets", self.before if self.domains else []), strict=False)) if self.residuals else []


def copies(rate: Column, key: Column, fewest: int = 0) -> Column:
    part = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.greatest(F.lit(fewest), F.floor(rate) + (part < rate - F.floor(rate)).cast("long")).cast("int")


def rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, fewest: int = 0, **options) -> DataFrame:
    """doc_id, n_tokens, posterior (map of domain to chance), rate, copies for each row of docs."""
    mixer = Mixer(docs, labels, domain, targets or TARGETS, key=F.xxhash64("doc_id", "text"), **options)
    out = mixer.held.withColumn("rate", mixer.rate())
    names = F.array(*map(F.lit, mixer.domains)).cast("array<string>")
    return out.select("doc_id", F.col("_n").alias("n_tokens"), F.map_from_arrays(names, "_p").alias("posterior"), "rate", copies(F.col("rate"), F.col("_key"), fewest).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, fewest: int = 0, **options) -> DataFrame:
    """docs, each row as often as its rate says."""
    mixer = Mixer(docs, labels, domain, targets or TARGETS, **options)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")  # its columns' names can't clash
    out = mixer.posteriors(own).withColumn("_copies", copies(mixer.rate(), F.xxhash64("_row.doc_id", "text"), fewest))
    return out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *[F.coalesce(F.try_element_at("posterior", F.lit(d)), F.lit(0.0)).alias(f"p_{d}") for d in TARGETS], "rate", "copies")


QUERIES, ORACLE = {"op4_soft_mixing": op4_soft_mixing}, {}
