"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how far each is to be trusted, and its
beliefs train the classifier that decides. Everything that touches a document is a DataFrame or SQL function.

Candidates: the matches of one pattern for each kind. Five labelers vote yes, no or nothing on each: the strict form of the kind, a gazetteer
(top-level domains, calling codes, given names, ...), the words beside it, the characters that touch it, and a checksum or the variety of its
characters. The corpus's votes are counted by kind (at most 3 ** 5 combinations each); from the counts, expectation-maximisation learns each
kind's share of true spans and each labeler's reliability, shared by all kinds. A logistic regression on features of the span, fitted to those
beliefs (at most 2 ** 8 combinations of features a kind), scores every candidate.

Base spans (email, ip, card, phone that pass their rule) always stay. A match of these kinds that fails its rule only votes along: it is never a
span. The other kinds are spans where the classifier's score is `THRESHOLD` or more.

A match's place is the length of all that stands before it, so each text is split at its matches; running totals go in two levels, as one list
grown element by element would cost the square of its length.

Defined results: a null or empty text has no spans (the digest of '' and an empty string); a null doc_id is kept; repeated rows get a row each; a
text without candidates is a row all the same; an empty table gives an empty result, and a corpus without candidates keeps the starting beliefs; a
very long text or run of characters is gone through once (no pattern starts anew inside a run, none recurs on the stack). Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize, table

#: Base kinds, in the order in which ties go, then the kinds that the method adds.
BASE = ["email", "ip", "card", "phone"]
ADDED = ["secret", "national_id", "iban", "name", "address", "handle", "local_phone"]
KINDS = BASE + ADDED
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Highway"
#: What a candidate of each kind looks like. Possessive where a shorter match could not go on; a run is entered at its start alone (or where the
#: match before it ended), which changes no match and keeps long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}\p{M}])\p{Lu}\p{Ll}{1,20} \p{Lu}\p{Ll}{1,20}(?![\p{L}\p{M}])",
    "address": rf"(?<![0-9A-Za-z])[0-9]{{1,5}} (?:[A-Z][a-z]{{1,20}} ){{1,3}}(?:{STREETS})(?![A-Za-z])",
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z0-9_]{2,30}+(?![@.][A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z.-])(?<!\+[0-9]{1,3}[ .-]?)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: What every match of a kind holds: texts without it are not searched.
HOLDS = {"email": "@", "handle": "@", "phone": "+", "national_id": "-"}
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
#: The strict form of a kind: its first labeler. Kinds without one abstain.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$", "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$", "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}$", "secret": r"^(?:[0-9a-f]{32,64}|(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z]).{20,128})$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$", "address": r"^[1-9][0-9]{0,4} ", "handle": r"^@[A-Za-z][A-Za-z0-9_]{3,}$",
    "local_phone": r"^(?:\([2-9][0-9]{2}\) ?[0-9]{3}-[0-9]{4}|[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4})$",
}
GIVEN = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Christopher|Daniel|Matthew|Anthony|Steven|Andrew|Kenneth|George|Edward|Brian|Kevin|Jason|Jeffrey|Gary|Nicholas|Eric|Stephen|Jonathan|Larry|Scott|"
    "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Margaret|Sandra|Ashley|Emily|Michelle|Amanda|Melissa|Deborah|Stephanie|Laura|Rebecca|Sharon|Cynthia|Kathleen|Angela|Anna|Emma|Nicole|Helen|"
    "Hans|Peter|Wolfgang|Klaus|Jürgen|Dieter|Manfred|Uwe|Günter|Ursula|Renate|Monika|Helga|Petra|Sabine|Jean|Pierre|Michel|André|Philippe|Alain|Jacques|Marie|Nathalie|Isabelle|Sylvie|Catherine|Françoise|"
    "José|Antonio|Manuel|Francisco|Juan|Javier|Carlos|Miguel|Pedro|María|Carmen|Josefa|Isabel|Dolores|Pilar|Teresa|Ana|Lucía|Elena"
)
#: The second labeler: a pattern that the match may hold, its vote then, and its vote otherwise. Kinds without one abstain.
GAZETTEER = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|co|us|uk|de|fr|es|it|nl|eu|ch|at|be|ca|au|jp|in|br|mx)$", 1, 0), "ip": (r"^(?:0|10\.|127\.|192\.168\.|169\.254\.|22[4-9]|2[3-5][0-9])", -1, 0), "card": (r"^[3-6]", 1, -1),
    "phone": (r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", 1, -1), "secret": (r"^(?:AKIA|ghp_|gho_|sk-|sk_|pk_|xox|AIza|eyJ)", 1, 0), "national_id": (r"^(?:123-45-6789|078-05-1120)", -1, 0),
    "iban": (r"^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)", 1, -1), "name": (rf"^(?:{GIVEN}) ", 1, -1), "address": (r"(?:Street|Avenue|Road|Boulevard|Drive)$", 1, 0),
    "local_phone": (r"^\(?[2-9][0-9][0-9]", 1, -1),
}
#: Words before a span that speak for its kind, and words that speak against any: the third labeler.
CONTEXT = {
    "email": r"e-?mail|contact|write to|@|correo|courriel", "ip": r"\bip\b|address|host|server|client|login", "card": r"card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta", "phone": r"phone|tel|call|mobile|cell|fax|contact|t[ée]l",
    "secret": r"token|secret|passw|pwd|api.?key|\bkey\b|bearer|auth|credential", "national_id": r"ssn|social|security|tax|\bid\b", "iban": r"iban|account|konto|compte|cuenta|bank", "name": r"\b(?:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|se[ñn]or|se[ñn]ora|name|by|dear|from)\b[.: ]*$",
    "address": r"address|live|resid|street|ship|mail", "handle": r"follow|twitter|insta|user|handle|dm\b|contact", "local_phone": r"phone|tel|call|mobile|cell|fax|contact|t[ée]l",
}
AGAINST = r"version|release|isbn|issn|order|invoice|sha|commit|build|https?:|www\.|example of|section|figure|table"
#: Labelers, features of a span; how much the starting beliefs weigh, in spans; how far a labeler is trusted at first, at least and at most.
LABELERS = ["strict", "gazetteer", "context", "neighbours", "variety"]
FEATURES = ["context", "against", "strict", "gazetteer", "touched", "uniform", "long", "assigned"]
WEIGHT, TRUST, LEAST_TRUST, MOST_TRUST = 20.0, 0.75, 0.55, 0.98
ROUNDS, RIDGE, THRESHOLD = 50, 0.1, 0.5
#: Characters on either side of a match that are looked at.
BESIDE = 40
#: Elements of a list that are added up one by one.
RUN = 256


def running(values: Column) -> Column:
    """The running totals of a list of longs: within runs of `RUN`, then over the runs' totals."""
    zero = F.lit(0).cast("long")

    def totals(xs: Column) -> Column:
        return F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    firsts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(firsts, lambda k: totals(F.slice(values, k * RUN + 1, F.lit(RUN))))
    before = totals(F.transform(runs, lambda r: F.element_at(r, -1)))
    return F.flatten(F.zip_with(runs, F.slice(before, F.lit(1), F.size(runs)), lambda r, b: F.transform(F.slice(r, F.lit(2), F.size(r) - 1), lambda x: x + b)))


def matches(rows: DataFrame, text: str, pattern: str, name: str, holds: str = "") -> DataFrame:
    """rows with `name`, the list of the pattern's matches in a text: start, end (code points), said, before and after (up to `BESIDE` characters)."""
    said, gaps, end = f"{name}_said", f"{name}_gaps", f"{name}_end"
    none = F.array().cast("array<string>")
    rows = rows.withColumn(said, F.when(F.contains(text, F.lit(holds)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn(gaps, F.when(F.size(said) > 0, F.split(text, pattern, -1)).otherwise(none))
    n = F.size(said)
    rows = rows.withColumn(end, running(F.zip_with(F.slice(gaps, F.lit(1), n), said, lambda g, s: (F.length(g) + F.length(s)).cast("long"))))
    said_at = F.zip_with(said, end, lambda s, e: F.struct((e - F.length(s)).alias("start"), e.alias("end"), s.alias("said")))
    beside = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda b, a: F.struct(F.right(b, F.lit(BESIDE)).alias("before"), F.left(a, F.lit(BESIDE)).alias("after")))
    zipped = F.zip_with(said_at, beside, lambda m, c: F.struct(m["start"], m["end"], m["said"], c["before"], c["after"]))
    return rows.withColumn(name, zipped).drop(said, gaps, end)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes(kind: str, said: Column) -> Column:
    """The rule of a base kind."""
    if kind == "ip":
        return F.rlike(said, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))
    if kind == "card":
        return F.when(F.length(digits(said)).between(12, 19), F.call_function("luhn_check", digits(said))).otherwise(False)
    if kind == "phone":
        return F.length(digits(said)).between(9, 15)
    return F.lit(kind == "email")


def vote(yes: Column, otherwise: int = -1) -> Column:
    return F.when(yes, 1).otherwise(otherwise)


def various(kind: str, said: Column) -> Column:
    """A checksum where the kind has one, or else whether the characters vary; the fifth labeler."""
    if kind in ("ip", "card", "phone"):
        return vote(passes(kind, said))
    if kind == "iban":
        # the country and check digits go to the end, letters are numbers from 10 on, and the remainder by 97 is 1
        moved = F.replace(said, F.lit(" "), F.lit(""))
        moved = F.concat(F.substring(moved, F.lit(5), F.length(moved)), F.substring(moved, 1, 4))
        left = F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda acc, i: _mod97(acc, F.substring(moved, i, F.lit(1))))
        return vote(left == 1)
    if kind == "secret":
        distinct = F.size(F.array_distinct(F.split(F.left(said, F.lit(256)), "")))
        return vote((distinct >= 8) & F.rlike(said, F.lit("[0-9]")) & F.rlike(said, F.lit("[A-Za-z]")))
    if kind in ("national_id", "local_phone"):
        return F.when(F.size(F.array_distinct(F.split(digits(said), ""))) < 4, -1).otherwise(0)
    return F.lit(0)


def _mod97(acc: Column, c: Column) -> Column:
    value = F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    return (acc * F.when(value >= 10, 100).otherwise(10) + value) % 97


def judge(kind: str):
    return lambda x: judged(kind, x)


def judged(kind: str, x: Column) -> Column:
    """A match as a candidate: start, kind (number), end, base, its votes (a digit of three for each labeler) and features (bits)."""
    said, before, after = x["said"], x["before"], x["after"]
    bare = F.lit(0)
    for_it, against = F.rlike(before, F.lit("(?i)" + CONTEXT[kind])), F.rlike(before, F.lit("(?i)" + AGAINST))
    known, if_so, if_not = GAZETTEER.get(kind, ("^", 0, 0))
    touched = F.rlike(before, F.lit(r"[\p{L}\p{N}_/\\]$")) | F.rlike(after, F.lit(r"^[\p{L}\p{N}_/\\]"))
    votes = [vote(F.rlike(said, F.lit(STRICT[kind]))) if kind in STRICT else bare, F.when(F.rlike(said, F.lit(known)), if_so).otherwise(if_not), F.when(for_it, 1).when(against, -1).otherwise(0), F.when(touched, -1).otherwise(0), various(kind, said)]
    strict, gaz, _, _, variety = votes
    facts = [for_it, against, strict == 1, gaz == 1, touched, variety == -1, F.length(said) >= 16, F.rlike(before, F.lit(r"""[:=]\s*["'(]?$"""))]
    code = sum(((v + 1) * 3**k for k, v in enumerate(votes)), bare)
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(facts)), bare)
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), passes(kind, said).alias("base"), code.cast("int").alias("votes"), bits.cast("int").alias("bits"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of each row, in the order of their starts."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        rows = matches(rows, "text", PATTERNS[kind], f"of_{kind}", HOLDS.get(kind, ""))
    all_ = F.concat(*(F.transform(f"of_{kind}", judge(kind)) for kind in KINDS))
    return rows.select("doc_id", F.array_sort(all_).alias("found"))


class Beliefs:
    """Each kind's share of true spans, and the chance that a labeler's vote, where it has one, is right. Labelers are taken to be better than
    chance, which keeps true and false from changing places."""

    def __init__(self):
        self.trust, self.share = np.full(len(LABELERS), TRUST), np.full(len(KINDS), 0.5)

    def fit(self, counted: list[tuple[int, int, bool, int]], rounds: int = ROUNDS) -> Beliefs:
        """Expectation-maximisation over (kind, votes, base, spans), with the starting beliefs as `WEIGHT` spans. The rule of a base kind settles
        the truth of its matches."""
        if not counted:
            return self
        kind, code, base, n = np.array(sorted(counted), np.int64).T
        votes = self.votes(code)
        spoke, total = (votes != 0) * n[:, None], np.bincount(kind, n, minlength=len(KINDS))
        for _ in range(rounds):
            true = np.where(kind < len(BASE), base, self.of(kind, code))
            right = np.where(votes > 0, true[:, None], 1 - true[:, None])
            self.trust = np.clip(((spoke * right).sum(axis=0) + WEIGHT * TRUST) / (spoke.sum(axis=0) + WEIGHT), LEAST_TRUST, MOST_TRUST)
            self.share = (np.bincount(kind, true * n, minlength=len(KINDS)) + WEIGHT / 2) / (total + WEIGHT)
        return self

    @staticmethod
    def votes(code: np.ndarray) -> np.ndarray:
        return code[:, None] // 3 ** np.arange(len(LABELERS)) % 3 - 1

    def odds(self) -> tuple[np.ndarray, np.ndarray]:
        """The log odds of each kind's share, and those that each labeler's vote adds."""
        return np.log(self.share / (1 - self.share)), np.log(self.trust / (1 - self.trust))

    def of(self, kind: np.ndarray, code: np.ndarray) -> np.ndarray:
        share, by_vote = self.odds()
        return 1 / (1 + np.exp(-(share[kind] + self.votes(code) @ by_vote)))

    def column(self, kind: Column, code: Column, base: Column) -> Column:
        share, by_vote = self.odds()
        logit = F.get(F.array(*map(F.lit, share.tolist())), kind)
        for k, w in enumerate(by_vote.tolist()):
            logit = logit + (F.floor(code / 3**k).cast("int") % 3 - 1) * w
        return F.when(kind < len(BASE), base.cast("double")).otherwise(F.lit(1.0) / (F.exp(-logit) + 1))


class SpanClassifier:
    """A logistic regression on a span's kind and features."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights  # kinds, then features

    @classmethod
    def fit(cls, counted: list[tuple[int, int, int, float]], rounds: int = ROUNDS) -> SpanClassifier:
        """Newton's steps over (kind, bits, spans, sum of the beliefs), with a ridge."""
        w = np.zeros(len(KINDS) + len(FEATURES))
        if counted:
            kind, bits, n, true = np.array(sorted(counted), float).T
            x = np.hstack([np.eye(len(KINDS))[kind.astype(int)], (bits.astype(int)[:, None] >> np.arange(len(FEATURES))) & 1])
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-x @ w))
                step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (true - n * p) - RIDGE * w)
                w = w + np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-9:
                    break
        return cls(w)

    def score(self, kind: Column, bits: Column) -> Column:
        logit = F.get(F.array(*map(F.lit, self.weights[: len(KINDS)].tolist())), kind)
        for k, w in enumerate(self.weights[len(KINDS) :].tolist()):
            logit = logit + F.when(bits.bitwiseAND(1 << k) != 0, w).otherwise(0.0)
        return F.lit(1.0) / (F.exp(-logit) + 1)


def learn(found: DataFrame) -> tuple[Beliefs, SpanClassifier]:
    """From all candidates: what to believe of kinds and labelers, and the classifier fitted to it. Only counts by votes or features come to the
    driver: 486 and 256 rows a kind at most."""
    each = found.select(F.inline("found"))
    votes = each.groupBy("kind", "votes", "base").agg(F.count("*").alias("n")).collect()
    beliefs = Beliefs().fit([(r["kind"], r["votes"], r["base"], r["n"]) for r in votes])
    counts = each.groupBy("kind", "votes", "base", "bits").agg(F.count("*").alias("n"))
    belief = F.round(beliefs.column(F.col("kind"), F.col("votes"), F.col("base")), 6)
    told = counts.groupBy("kind", "bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * belief).alias("true")).collect()
    return beliefs, SpanClassifier.fit([(r["kind"], r["bits"], r["n"], round(r["true"], 3)) for r in told])


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans of each row: start, end (exclusive, in code points), kind (name), base and score, by start and kind."""
    found = materialize(candidates(docs), "candidates")
    _, classifier = learn(found)
    names = F.array(*map(F.lit, KINDS))
    scored = F.transform("found", lambda x: F.struct(x["start"], x["end"], x["kind"].alias("order"), F.get(names, x["kind"]).alias("kind"), x["base"], classifier.score(x["kind"], x["bits"]).alias("score")))
    kept = F.filter(scored, lambda x: x["base"] | ((x["order"] >= len(BASE)) & (x["score"] >= threshold)))
    return found.select("doc_id", F.transform(kept, lambda x: F.struct(*(x[k].alias(k) for k in ("start", "end", "kind", "base", "score")))).alias("spans"))


def said(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda k: F.filter(base, lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
