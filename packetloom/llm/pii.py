"""PII: labelers vote on candidate spans, expectation-maximisation weighs them. DataFrame operations only.

Base kinds (email, ip, card, phone) come from fixed patterns and always stay. The method adds spans of the kinds
`secret`, `id` (personal numbers) and `address` (mail addresses in disguise): candidates are tokens that a wide pattern finds (key = value pairs, long
mixed tokens, obfuscated addresses, digit groups) outside base spans. Nine labelers vote yes, no or nothing on each: shapes of
the value (how often letters and digits change inside a part, parts that read as words and numbers, digests and
identifiers without a name, dates and versions), gazetteers of names and prefixes, and the text before the token (a secret's
name, a harmless one, a path or link). The counts of the vote patterns (at most 3^9 rows)
feed expectation-maximisation, which estimates each labeler's reliability and the chance of each pattern;
with these chances as weights a naive Bayes classifier over binned span features (length, digits, case mix,
entropy, changes) is trained, and a candidate is a span when votes and classifier together give at least `accept`.

Null and empty texts have no spans; repeated rows and null ids are rows like others. Whole texts are scanned once per kind whose needed character occurs in
them. Columns besides doc_id and text are ignored; a row comes out for each row. Without any candidate
the method adds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import stash, table

# The patterns of the base kinds. Possessive quantifiers and \G only spare the engine
# retries that cannot match; they find the same spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wide: what the labelers vote on. First what has a form of its own, then long mixed tokens in the text between. No bound
#: on values; a run of token characters is scanned from its start only.
FORMED = r"(?:\G|(?<![A-Za-z0-9_]))(?:[A-Za-z_]{3,24}\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_.-]{6,}+[\x22']?|[A-Za-z0-9._-]{2,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,12}|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))"
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+"
#: Gazetteers.
SECRET_NAMES = ["password", "passwd", "passphrase", "pwd", "secret", "client_secret", "token", "access_token", "refresh_token", "id_token", "bearer", "session_id", "cookie",
                "api_key", "apikey", "access_key", "secret_key", "private_key", "signing_key", "encryption_key", "auth", "auth_key", "authorization", "credential", "credentials", "otp", "iban", "passport", "ssn"]
SECRET_PREFIXES = ["AKIA", "ASIA", "AIza", "ya29.", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xapp-", "sk_live_", "rk_live_", "sk_test_", "sk-", "pk_live_", "SG.", "npm_", "pypi-", "dop_v1_", "hf_", "eyJ"]
CONTEXT = r"(?i)(?:password|secret|token|key|login|credential|contact|mail|reach|ssn|account)\W*$"
HARMLESS = r"(?i)(?:(?:commit|revision|version|release|model|build|branch|file|image|digest|checksum|sha[0-9]*|md5|uuid|guid|article|order|part|serial|see|https?|doi|isbn)\W*|[A-Za-z0-9][/.:]|//)$"


def matches(text: Column, pattern: str, needs: Column) -> Column:
    """array<struct<s, e, t>>: the leftmost matches with their code point offsets; nothing where needs is false."""
    whole = F.concat(F.lit("("), F.lit(pattern), F.lit(")"))
    found = F.regexp_extract_all(text, whole, F.lit(1))
    between = F.split(text, pattern, -1)
    zero = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def add(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["b"])
        e = s + F.length(x["t"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda t, b: F.struct(t.alias("t"), b.alias("b")))
    return F.when(needs, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), zero.alias("out")), add)["out"]).otherwise(zero)


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `wide`: the formed candidates, and the mixed tokens of the text with these blanked, by their place."""
    text = F.coalesce("text", F.lit(""))
    needs = text.rlike(r"[=:]|[A-Za-z][0-9]|[0-9][A-Za-z_-]|[\[(](?:at|AT)[\])]")
    docs = docs.withColumn("formed", matches(text, FORMED, needs))
    blanks = F.transform("formed", lambda m: F.repeat(F.lit(" "), F.length(m["t"])))
    left = F.zip_with(F.split(text, FORMED, -1), blanks, lambda b, x: F.concat(b, F.coalesce(x, F.lit(""))))
    docs = docs.withColumn("left", F.when(text.rlike(MIXED), F.when(F.size("formed") > 0, F.array_join(left, "")).otherwise(text)))
    return docs.withColumn("wide", F.array_sort(F.concat("formed", matches(F.col("left"), MIXED, F.col("left").isNotNull())))).drop("formed", "left")


def digits(t: Column) -> Column:
    return F.translate(t, "+-(). ", "")


def luhn(t: Column) -> Column:
    d = F.transform(F.filter(F.split(F.reverse(digits(t)), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, in the contract's order."""
    digit = text.rlike("[0-9]")
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda m: F.forall(F.split(m["t"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), -4, 4).cast("int"), F.lit(0)) <= 255))),
        "card": F.filter(matches(text, CARD, digit), lambda m: (F.length(digits(m["t"])).between(16, 19)) & F.when(F.length(digits(m["t"])).between(16, 19), luhn(m["t"])).otherwise(False)),
        "phone": F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda m: F.length(digits(m["t"])).between(8, 15)),
    }


LABELERS = ["assigned", "mixed", "worded", "named", "prefixed", "context", "digest", "dated", "formed"]
NUMBER, DISGUISED = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", r"[\[(](?:at|AT)[\])]"
#: A part of a harmless token: a word with a number or without, a number with a unit, a short name with both.
PART = r"^(?:(?:[A-Z]{0,2}[a-z]+|[A-Z]+)[0-9]*|[0-9]+[A-Za-z]{0,3}|[A-Za-z]{1,3}[0-9]+[A-Za-z]{0,2})?$"
DIGEST = r"^(?:[0-9a-f]{7,12}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})$"
DATED = r"(?:^|[^0-9])(?:19|20)[0-9]{2}[-_/.]?(?:0[1-9]|1[0-2])(?:[-_/.]?(?:0[1-9]|[12][0-9]|3[01]))?(?:[^0-9]|$)|(?:^|[-_/.])[vV]?[0-9]+[._][0-9]+(?:[-_/.]|$)|[-_/.][vV][0-9]{1,3}(?:[-_/.]|$)"


def changes(t: Column) -> Column:
    """How often letters and digits change over inside the parts of t."""
    return F.regexp_count(t, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))


def bare(t: Column) -> Column:
    """A candidate without its name and quotes."""
    return F.regexp_replace(t, r"^[A-Za-z_]{3,24}\x20?[=:]\x20?|[\x22']", "")


def votes(t: Column, before: Column) -> dict[str, Column]:
    """1: personal or secret, 0: not, -1: nothing to say."""
    low, value = F.lower(t), bare(t)
    name = F.trim(F.regexp_extract(low, r"^([a-z_]{3,24})\x20?[=:]", 1))
    own = t.rlike(NUMBER) | t.rlike(DISGUISED)
    secret = name.isin(SECRET_NAMES) | F.exists(F.array(*map(F.lit, SECRET_NAMES)), lambda s: F.endswith(name, F.concat(F.lit("_"), s)))
    known = F.exists(F.array(*map(F.lit, SECRET_PREFIXES)), lambda p: F.startswith(value, p))
    told = before.rlike(CONTEXT)
    digest = value.rlike(DIGEST) & ~secret & ~told & ~known  # its mix is its format
    worded = F.forall(F.split(value, "[^A-Za-z0-9]+"), lambda x: x.rlike(PART))
    return {
        "assigned": F.when(own, -1).when(t.rlike(r"[=:]") & ((F.length(value) < 8) | value.rlike("^(?:[0-9]+|//.*)$")), 0).when(t.rlike(r"[=:]") & ~worded, 1).otherwise(-1),
        "mixed": F.when(own | digest, -1).when((F.length(value) >= 12) & (changes(value) >= F.greatest(F.lit(4.0), F.length(value) / 8)), 1).when(changes(value) <= 2, 0).otherwise(-1),
        "worded": F.when(own | known, -1).when(worded, 0).otherwise(-1),
        "named": F.when(secret, 1).when(name != "", 0).otherwise(-1),
        "prefixed": F.when(known, 1).otherwise(-1),
        "context": F.when(told, 1).when((name == "") & before.rlike(HARMLESS), 0).otherwise(-1),
        "digest": F.when(digest, 0).otherwise(-1),
        "dated": F.when(value.rlike(DATED) & ~known & ~own, 0).otherwise(-1),
        "formed": F.when(t.rlike(r"^(?:000|666|9..)-|-00-|-0000$") & t.rlike(NUMBER), 0).when(own, 1).otherwise(-1),
    }


def features(t: Column) -> dict[str, Column]:
    """Binned features of the value for the span classifier; names are the labelers' matter."""
    t = bare(t)
    n = F.greatest(F.length(t), F.lit(1))
    distinct = F.size(F.array_distinct(F.split(t, ""))) / n
    return {
        "size": F.least(F.floor(F.log2(n)), F.lit(7)).cast("int"),
        "digit": F.floor(4 * F.length(F.regexp_replace(t, "[^0-9]", "")) / n).cast("int"),
        "upper": F.floor(4 * F.length(F.regexp_replace(t, "[^A-Z]", "")) / n).cast("int"),
        "spread": F.floor(4 * distinct).cast("int"),
        "change": F.least(F.floor(16 * changes(t) / n), F.lit(7)).cast("int"),
    }


def expect(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[list[float], list[float]]]]:
    """The share of true spans, and for each labeler the weights of (-1, 0, 1) on false and on true spans: its chances to vote 0 or 1 when
    it votes; saying nothing tells nothing. Ten votes beforehand, two of them wrong, hold that labelers are mostly right."""
    total = sum(n for _, n in patterns)
    yes = [(1 + 2 * sum(v == 1 for v in p)) / (2 + 2 * sum(v >= 0 for v in p)) for p, _ in patterns]
    prior, tables = 0.5, []
    for _ in range(rounds):
        tables = []
        for j in range(len(patterns[0][0]) if patterns else len(LABELERS)):
            each = [[8.0, 2.0], [2.0, 8.0]]
            for (p, n), y in zip(patterns, yes, strict=True):
                if p[j] >= 0:
                    each[0][p[j]] += n * (1 - y)
                    each[1][p[j]] += n * y
            tables.append(tuple([1.0, *(c / sum(x) for c in x)] for x in each))
        prior = min(0.99, max(0.01, sum(n * y for (_, n), y in zip(patterns, yes, strict=True)) / max(1, total)))
        yes = [1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(math.log(tables[j][1][v + 1] / tables[j][0][v + 1]) for j, v in enumerate(p)))) for p, _ in patterns]
    return prior, tables


def log_odds(prior: float, tables: list) -> Column:
    """The log odds that a candidate's votes give it."""
    vote = F.lit(math.log(prior / (1 - prior)))
    for name, (no, yes) in zip(LABELERS, tables, strict=True):
        vote = vote + F.element_at(F.array(*[F.lit(math.log(y / n)) for n, y in zip(no, yes, strict=True)]), F.col(name) + 2)
    return vote


def binned(found: DataFrame, vote: Column) -> DataFrame:
    """The classifier's table, weighted by the votes' chances: feature, value, yes, no (bounded by the bins)."""
    weight = 1 / (1 + F.exp(-vote))
    bins = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in found.columns if c.startswith("f_")]
    return found.select(weight.alias("w"), F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.value").agg(F.sum("w").alias("yes"), F.sum(1 - F.col("w")).alias("no"))


def find(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """doc_id, email, ip, card, phone (arrays of s, e, t) and extra (array of kind, s, e) for each row of docs."""
    docs = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    text = F.coalesce("text", F.lit(""))
    base = base_spans(text)
    docs = candidates(docs)
    wide = F.transform("wide", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["t"].alias("t"), F.substring(text, F.greatest(m["s"] - 23, F.lit(1)), F.least(m["s"], F.lit(24))).alias("before")))
    rows = stash(docs.select("doc_id", "row", *[c.alias(k) for k, c in base.items()], wide.alias("wide")), "pii-spans")
    taken = F.concat(*[F.col(k) for k in base])
    apart = F.filter("wide", lambda m: ~F.exists(taken, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    found = rows.select("row", F.explode(apart).alias("m")).select("row", "m.*")
    kind = F.when(F.col("t").rlike(NUMBER), "id").when(F.col("t").rlike(DISGUISED), "address").otherwise("secret")
    # kinds with a form of their own have reliabilities of their own, and no look of a secret
    found = stash(found.select("row", "s", "e", kind.alias("kind"), (kind != "secret").alias("own"), *[v.alias(k) for k, v in votes(F.col("t"), F.col("before")).items()], *[v.alias(f"f_{k}") for k, v in features(F.col("t")).items()]), "pii-votes")
    patterns = {True: [], False: []}
    for r in found.groupBy("own", *LABELERS).agg(F.count("*").alias("n")).collect():
        patterns[r["own"]].append((tuple(r[k] for k in LABELERS), r["n"]))
    if not any(patterns.values()):
        return rows.select("doc_id", *base, F.array().cast("array<struct<kind:string,s:int,e:int>>").alias("extra"))
    by_form = log_odds(*expect(sorted(patterns[True])))
    vote = log_odds(*expect(sorted(patterns[False])))
    bins = binned(found.where("NOT own"), vote)
    held = bins.collect()
    all_yes, all_no = sum(r["yes"] for r in held) / 5, sum(r["no"] for r in held) / 5
    odds = {(r["feature"], r["value"]): math.log((r["yes"] + 1) / (all_yes + 8)) - math.log((r["no"] + 1) / (all_no + 8)) for r in held}
    lean = sum((F.coalesce(F.element_at(F.create_map(*[F.lit(x) for (f, v), o in sorted(odds.items()) if f == name for x in (v, o)]), F.col(name)), F.lit(0.0)) for name in sorted({f for f, _ in odds})), F.lit(0.0))
    # the classifier has the votes' word as a prior; a labeler that says nothing leaves it to the features
    judged = found.where(1 / (1 + F.exp(-F.when(F.col("own"), by_form).otherwise((vote + lean) / 2))) >= accept)
    extra = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias("extra"))
    out = rows.join(extra, "row", "left")
    return out.select("doc_id", *base, F.coalesce("extra", F.array().cast("array<struct<kind:string,s:int,e:int>>")).alias("extra"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    kinds = ["email", "ip", "card", "phone"]
    told = lambda k: F.transform(k, lambda m: F.concat_ws(":", F.lit(k), m["s"], m["e"]))
    base = F.concat(*map(told, kinds))
    every = F.concat(base, F.transform("extra", lambda m: F.concat_ws(":", m["kind"], m["s"], m["e"])))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
                      F.size("extra").cast("long").alias("n_extra"), F.size(every).cast("long").alias("n_spans"))


QUERIES, ORACLE = {"op10_pii": op10_pii}, {}
