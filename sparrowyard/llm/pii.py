"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides on spans.

1. Candidates: the four base kinds (email, ip, card, phone; each validated) and wider patterns for secrets,
   local phone numbers, national ids, IBANs and spelled-out addresses.
2. Labelers vote +1, 0 or -1 on each candidate: its shape, two gazetteers (known issuers, prefixes and
   domains; known placeholders), words before it, words that speak against it, and its delimiters.
3. Expectation-maximisation over the counts of vote patterns of ALL candidates estimates how reliable each
   labeler is (naive Bayes with a latent class, one prior per kind) without labels.
4. A logistic span classifier is fitted to the posteriors and accepts or refuses the wider candidates.
   Base spans always stay; accepted spans that overlap a base span are left out.

Text work is built-in SQL functions only. The driver sees the table of vote patterns, which has at most
kinds x 3**labelers rows (6,561) whatever the corpus, and runs EM and the classifier's fit on it.

Offsets are code points, end exclusive. Start offsets are sums of lengths of the pieces between matches, so
very long texts are handled whole; patterns are written with possessive quantifiers and run-start anchors,
which match what the plain patterns match without their quadratic restarts. Defined results: null and empty
texts have no spans; repeated rows are judged alike; an empty table stays empty, and with no candidates the
classifier accepts none. Other columns, whatever their names, stay inside struct ``row``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of equal starts.
BASE = ("email", "ip", "card", "phone")
WIDER = ("iban", "national_id", "phone_local", "email_text", "secret")
KINDS = BASE + WIDER

# A match starts at the end of the one before (\G) or where a run of its first class starts.
_FROM = r"(?:\G|(?<![{0}]))"
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": _FROM.format(_LOCAL) + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _FROM.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = (
    r"(?:\G|(?<![A-Za-z0-9]))(?:"
    r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
    r"|\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
    r"|[A-Za-z0-9._-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z]{2,24}+"
    r"|[A-Za-z0-9_-]{20,}+"
    r")"
)

# Gazetteers and cue words.
KNOWN = {
    "email": r"@(?:.*\.)?(?:gmail|yahoo|hotmail|outlook|icloud|proton|gmx|aol|example)\.",
    "ip": r"^(?:10\.|172\.|192\.168\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "iban": r"^(?:DE|FR|ES|IT|GB|NL|BE|AT|CH|PT|PL|SE|NO|DK|FI|IE|LU|CZ|HU|GR)",
    "secret": r"^(?:sk-|sk_|pk_|ghp_|gho_|glpat-|xox[abp]-|AKIA|AIza|eyJ)",
}
PLACEHOLDER = r"^(?:.{0,3})(.)\1{7,}|1234567890|0123456789|deadbeef|xxxxxx|000-00-0000|^0\.0\.0\.0|^127\.0\.0\.1|^255\.255"
CUES = r"e-?mail|contact|write to|phone|tel\b|call|mobile|fax|card|visa|credit|payment|iban|account|ssn|social security|passport|token|secret|passw|api.?key|bearer|credential|\bip\b|host|login"
AGAINST = r"version|\bv$|isbn|issn|doi|commit|sha-?\d|md5|checksum|build|figure|page|chapter|section|\byear|order no|part no|uuid"
SHAPE = {
    "email": r"\.[A-Za-z]{2,24}$",
    "ip": r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$",
    "phone": r"^\+[1-9]",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "phone_local": r"^\(?[2-9][0-9]{2}\)?[ .-]{1,2}[2-9]",
    "email_text": r"[\[(]dot[\])]",
    "secret": r"^(?=(?:[^0-9]*[0-9]){3})(?=(?:[^A-Za-z]*[A-Za-z]){3})",
}
LABELERS = ("shape", "known", "placeholder", "cue", "against", "delimited")
CONTEXT = 40


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _lengths(k: str) -> Column:
    """Length of each match together with the piece before it."""
    return F.transform(f"m_{k}", lambda x, i: F.length(F.get(f"g_{k}", i)) + F.length(x))


def _sums_of_64(a: str) -> Column:
    """Sums of 64 numbers each, so that the place of each of many matches takes few additions; over two levels, 64 each and one in 4,096."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 64).cast("int")), lambda b: _total(F.slice(a, b * 64 + 1, F.lit(64))))


def _spans(k: str) -> Column:
    """Structs ``s, e, m, pre, post`` of the matches of ``k``."""
    gap = lambda i: F.get(f"g_{k}", i)

    def span(x: Column, i: Column) -> Column:
        full, far = F.floor(i / 64).cast("int"), F.floor(i / 4096).cast("int")
        s = _total(F.slice(f"c_{k}", F.lit(1), far)) + _total(F.slice(f"b_{k}", far * 64 + 1, full % 64)) + _total(F.slice(f"l_{k}", full * 64 + 1, i % 64)) + F.length(gap(i))
        return F.struct(
            s.alias("s"), (s + F.length(x)).alias("e"), x.alias("m"),
            F.substring(gap(i), -CONTEXT, CONTEXT).alias("pre"), F.substring(gap(i + 1), 1, 12).alias("post"),
        )

    return F.transform(f"m_{k}", span)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 0, value(i)).otherwise(F.when(value(i) < 5, value(i) * 2).otherwise(value(i) * 2 - 9))
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _wider_kind(m: Column) -> Column:
    """Kind of a wider candidate; null where the candidate has neither enough digits nor letters."""
    return (
        F.when(m.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), "iban")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national_id")
        .when(m.rlike(r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"), "phone_local")
        .when(m.rlike(r"[\[(]at[\])]"), "email_text")
        .when(m.rlike(r"[0-9]") & m.rlike(r"[A-Za-z]"), "secret")
    )


def _votes(x: Column) -> Column:
    """Votes of the labelers on a candidate struct, in the order of LABELERS."""
    def by_kind(table: dict[str, str], yes: int, no: int) -> Column:
        out = F.lit(0)
        for kind, pattern in table.items():
            out = F.when(x["kind"] == kind, F.when(x["m"].rlike(pattern), yes).otherwise(no)).otherwise(out)
        return out

    pre = F.lower(x["pre"])
    open_left = pre.rlike(r"(?:^|[\s=:(\[\"'<,;])$")
    open_right = x["post"].rlike(r"^(?:$|[\s.,;:!?)\]\"'>])")
    return F.array(
        by_kind(SHAPE, 1, -1),
        by_kind(KNOWN, 1, 0),
        F.when(F.lower(x["m"]).rlike(PLACEHOLDER), -1).otherwise(0),
        F.when(pre.rlike(CUES), 1).otherwise(0),
        F.when(pre.rlike(f"(?:{AGAINST})[^.!?]{{0,16}}$"), -1).otherwise(0),
        F.when(open_left & open_right, 1).when(~open_left & ~open_right, -1).otherwise(0),
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` packed as struct ``row`` with arrays ``base`` and ``wide`` of ``kind, s, e, votes``."""
    t = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    none = F.array().cast("array<string>")
    find = lambda p, when: F.when(when, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none)
    digit = t.rlike("[0-9]")
    wanted = {"email": t.contains("@"), "ip": digit, "card": digit, "phone": t.contains("+"), "wide": digit | t.contains("at")}
    patterns = PATTERNS | {"wide": WIDE}
    df = docs.select(F.struct("*").alias("row"))
    df = df.select("row", *[find(p, wanted[k]).alias(f"m_{k}") for k, p in patterns.items()])
    df = df.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split(t, p, -1)).otherwise(none).alias(f"g_{k}") for k, p in patterns.items()])
    df = df.select("*", *[_lengths(k).alias(f"l_{k}") for k in patterns])
    df = df.select("*", *[_sums_of_64(f"l_{k}").alias(f"b_{k}") for k in patterns])
    df = df.select("*", *[_sums_of_64(f"b_{k}").alias(f"c_{k}") for k in patterns])
    df = df.select("row", *[_spans(k).alias(k) for k in patterns])
    named = lambda x, kind: F.struct(kind.alias("kind"), *[x[c] for c in ("s", "e", "m", "pre", "post")])
    valid = lambda k: F.transform(F.filter(k, lambda x: _valid(k, x["m"])), lambda x: named(x, F.lit(k)))
    df = df.select("row", F.concat(*map(valid, BASE)).alias("base"), F.transform("wide", lambda x: named(x, _wider_kind(x["m"]))).alias("wide"))
    clash = lambda x: F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    wide = F.filter("wide", lambda x: x["kind"].isNotNull() & ~clash(x))
    judged = lambda a: F.transform(a, lambda x: F.struct(x["kind"], x["s"], x["e"], _votes(x).alias("votes")))
    return df.select("row", judged(F.col("base")).alias("base"), judged(wide).alias("wide"))


@dataclass
class SpanModel:
    """Logistic span classifier with the reliabilities that its training labels came from."""

    bias: float = -1e9
    kinds: dict[str, float] = field(default_factory=dict)
    votes: dict[tuple[int, int], float] = field(default_factory=dict)
    reliabilities: dict[str, dict] = field(default_factory=dict)

    def score(self, x: Column) -> Column:
        out = F.lit(self.bias)
        for kind, w in self.kinds.items():
            out = out + F.when(x["kind"] == kind, w).otherwise(0.0)
        for (i, v), w in self.votes.items():
            out = out + F.when(F.get(x["votes"], F.lit(i)) == v, w).otherwise(0.0)
        return out

    def accepts(self, x: Column) -> Column:
        return self.score(x) >= 0


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60, smooth: float = 1.0):
    """Posteriors per pattern, P(vote | class) per labeler, and priors per kind; starts from majority votes."""
    post = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v, _ in patterns]
    tables, priors = [], {}
    for _ in range(rounds):
        tables = []
        for i in range(len(LABELERS)):
            t = {(y, v): smooth for y in (0, 1) for v in (-1, 0, 1)}
            for (_, votes, n), p in zip(patterns, post, strict=True):
                t[1, votes[i]] += n * p
                t[0, votes[i]] += n * (1 - p)
            tables.append({(y, v): t[y, v] / sum(t[y, u] for u in (-1, 0, 1)) for y in (0, 1) for v in (-1, 0, 1)})
        mass: dict[str, list[float]] = {}
        for (kind, _, n), p in zip(patterns, post, strict=True):
            m = mass.setdefault(kind, [smooth, smooth])
            m[1] += n * p
            m[0] += n * (1 - p)
        priors = {k: m[1] / (m[0] + m[1]) for k, m in mass.items()}
        new = []
        for kind, votes, _ in patterns:
            logit = math.log(priors[kind] / (1 - priors[kind])) + sum(math.log(tables[i][1, v] / tables[i][0, v]) for i, v in enumerate(votes))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
        moved, post = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0.0), new
        if moved < 1e-9:
            break
    return post, tables, priors


def fit(docs: DataFrame, text: str = "text", ridge: float = 1.0, rounds: int = 50) -> SpanModel:
    """EM and the classifier over the votes on all candidates of ``docs``."""
    import numpy as np

    found = candidates(docs, text).select(F.explode(F.concat("base", "wide")).alias("x"))
    counted = found.groupBy("x.kind", "x.votes").count().orderBy("kind", "votes").collect()  # at most kinds x 3**labelers rows
    patterns = [(r["kind"], tuple(r["votes"]), r["count"]) for r in counted]
    if not patterns:
        return SpanModel()
    post, tables, priors = expectation_maximisation(patterns)
    names: list = [("kind", k) for k in KINDS] + [(i, v) for i in range(len(LABELERS)) for v in (-1, 1)]
    x = np.array([[1.0] + [float(n[1] == k) if n[0] == "kind" else float(v[n[0]] == n[1]) for n in names] for k, v, _ in patterns])
    y, w = np.array(post), np.array([float(c) for _, _, c in patterns])
    beta, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep, x.T @ (w * (y - p)) - ridge * beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    beta = [round(float(b), 9) for b in beta]
    coefficients = dict(zip(names, beta[1:], strict=True))
    return SpanModel(
        beta[0],
        {n[1]: b for n, b in coefficients.items() if n[0] == "kind"},
        {n: b for n, b in coefficients.items() if n[0] != "kind"},
        {"labelers": dict(zip(LABELERS, tables, strict=True)), "priors": priors},
    )


def _ordered(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(z) for i, k in enumerate(KINDS) for z in (k, i)])
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), rank[x["kind"]].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def detect(docs: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """``docs`` packed as struct ``row`` with ``base`` and ``spans``: arrays of ``kind, s, e`` by start, then kind."""
    model = model or fit(docs, text)
    found = candidates(docs, text)
    return found.select("row", _ordered(F.col("base")).alias("base"), _ordered(F.concat("base", F.filter("wide", model.accepts))).alias("spans"))


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first to start names both."""
    found = detect(docs, model, text)
    t = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        inside = x["s"] < a["at"]
        piece = F.concat(F.substr(t, a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(piece))).alias("out"))

    whole = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(t, a["at"] + 1, F.length(t))))
    found = found.select("row", F.when(F.size("spans") > 0, whole).otherwise(F.col(f"row.{text}")).alias("new"))
    values = {text: F.col("new"), "n_chars": F.coalesce(F.length("new"), F.lit(0)).cast("long")}
    return found.select(*[(values[c] if c in values else F.col("row")[c]).alias(c) for c in docs.columns])
