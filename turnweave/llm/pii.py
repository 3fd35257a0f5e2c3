"""Personal data and secrets by weak supervision, in DataFrame functions alone.

Labelers vote on every candidate span: the strict pattern of its kind, a gazetteer (top-level domains
and mail providers, call codes, issuer digits, public address blocks, prefixes of access keys), the
words before it, its borders, signs of something else (a version, a hash), and its shape.
Expectation-maximisation over the counts of the vote patterns, of which there are a fixed number
whatever the input, estimates each labeler's reliability and each pattern's probability; a final
classifier is trained on these probabilities over the spans' features and decides which candidates
become spans. Spans of the strict patterns stay in any case; the classifier adds others: e-mail with
spelt-out signs, telephone numbers without +, numbers that the strict pattern lost because others
follow, addresses of version 6, secrets (keys, tokens, passwords, private keys) and numbers of
identity or account. An added span never touches a base span of its kind; secrets and numbers of
identity need a known prefix or words before them that say so.

All counts cover all documents. What comes to the driver is the table of counts by vote pattern and
features: at most ``2**6 * 3**2 * 6`` rows. Candidates (positions and votes, no texts) are found once
and written to the shared folder for training (with the rows, where these are to be masked); the
texts are never shuffled.

Defined results: a null text counts as empty and has no spans; ids, null or repeated, are carried
through row by row; other columns are ignored; an empty table gives an empty result. Positions are
code points, the end exclusive; spans that begin together stand in the order of ``ALL``. Texts of any
length are taken whole: patterns are written so that long runs of a character take time in
proportion (possessive, and begun only where a run begins), with the matches unchanged.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.common import table
from turnweave.runtime import materialise

KINDS = ("email", "ip", "card", "phone")
#: With those that have no strict pattern.
ALL = (*KINDS, "secret", "identity")
_LOCAL = r"A-Za-z0-9._%+-"
#: The contract's patterns. A match of the first begins a run of its characters or follows a match (\G).
STRICT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates: kind and pattern.
WIDE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9.])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"),
    ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,80}[0-9])[A-Za-z0-9+/_-]{20,500}+={0,2}(?![A-Za-z0-9+/_=-])"),
    ("secret", r"(?i)(?<![A-Za-z0-9])(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key)[\"']?\x20?[=:]\x20?[\"']?[^\s\"']{6,19}+(?![^\s\"'])"),
    ("secret", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,10000}+-----END [A-Z ]{0,20}PRIVATE KEY-----"),
    ("identity", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("identity", r"(?<![A-Z0-9a-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9a-z])"),
)
#: A text without these can't hold a candidate of the kind.
NEEDS = {
    "email": lambda t: t.contains("@") | t.contains("(at)") | t.contains("[at]"),
    "ip": lambda t: t.rlike("[0-9][.:]|[0-9A-Fa-f]:[0-9A-Fa-f]"),
    "card": lambda t: t.rlike("[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+") | t.rlike(r"[0-9]{3}[.-][0-9]{4}"),
    "secret": lambda t: t.rlike("[A-Za-z0-9+/_-]{20}|[=:]") & t.rlike("[0-9=:]"),
    "identity": lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]|[A-Z]{2}[0-9]{2}"),
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
BLOCK = 256
#: Fixed lists of the gazetteer and context labelers.
DOMAINS = "com org net edu gov info io de fr es it nl uk us ca au jp ch at be eu pl pt se".split()
PROVIDERS = "example gmail googlemail yahoo outlook hotmail icloud proton gmx web mail".split()
CALL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420 421".split()
KEY_PREFIXES = "AKIA ASIA AIza ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk- sk_live_ pk_live_ xoxa- xoxb- xoxp- eyJ".split()
GAZETTEER = {
    "email": rf"(?i)(@|at[)\]]\x20?)({'|'.join(PROVIDERS)})(?![A-Za-z0-9_])|(\.|dot[)\]]\x20?)({'|'.join(DOMAINS)})$",
    "ip": r"^(?!0\.|255\.)",
    "card": r"^(3[47]|4|5[1-5]|6(011|5))",
    "phone": rf"^(\+({'|'.join(CALL_CODES)})(?![0-9])|\(|[2-9])",
    "secret": rf"^({'|'.join(KEY_PREFIXES)}|-----BEGIN|(?i:passw|passphrase|pwd|secret|token|api[_-]?key))",
    "identity": r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|reach|kontakt|correo|courriel)\W*(\w+\W+){0,3}$",
    "ip": r"(?i)((?<![A-Za-z0-9_])ip(?![A-Za-z0-9_])|host|address|server|adresse|direcci)\W*(\w+\W+){0,3}$",
    "card": r"(?i)(card|visa|credit|karte|tarjeta|carte)\W*(\w+\W+){0,3}$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|anruf|llam|appel)\W*(\w+\W+){0,3}$",
    "secret": r"(?i)(token|secret|passw\w*|pwd|key|auth\w*|bearer|credentials?|schl[uü]ssel|clave|clé)\W{0,6}$",
    "identity": r"(?i)(ssn|social security|iban|account|konto\w*|cuenta|compte|passport|identity)\W*(\w+\W+){0,3}$",
}
_HASH = r"(?i)(token|key|secret|hash|sha|md5|version|(?<![A-Za-z0-9_])v)[\x20=:\"']*[0-9a-f]*$"
AGAINST = {k: _HASH for k in KINDS} | {"secret": r"(?i)(sha[0-9]*|md5|commit|checksum|digest|uuid|version|revision|https?:\S*|/)[\x20=:\"']*$", "identity": r"(?i)(version|part|model|serial)\W*$"}
#: What a span of the kind looks like, and what may not stand right before it.
SHAPE = {
    "email": r"[A-Za-z]{2,}$",
    "ip": r"^(?:(?:[1-9][0-9]{0,2}|0)(?:\.|$)){4}$|:",
    "card": r"^(?:[0-9][\x20-]?){13,15}[0-9]$|^(?:[0-9][\x20-]?){18}[0-9]$",
    "phone": r"[0-9)][\x20.()-]+[0-9]",
    "secret": r"[0-9][^0-9]+[0-9]|PRIVATE KEY|[=:]",
    "identity": r"^[0-9]{3}-|[0-9]{6}",
}
BEFORE = {k: r"[A-Za-z0-9.:]$" for k in KINDS} | {"secret": r"[A-Za-z0-9]$", "identity": r"[A-Za-z0-9.:]$"}


def _matches(text: Column, kind: str, pattern: str) -> tuple[Column, Column]:
    """The matches and the pieces of text between them; none where the text can't hold any."""
    has = NEEDS[kind](text)
    none = F.array().cast("array<string>")
    return F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(has, F.split(text, pattern, -1)).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Of a string of at most 19 digits: every second digit from the right doubled, nine taken off if above."""
    n = F.length(x)

    def digit(total: Column, i: Column) -> Column:
        d = F.substring(x, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), digit) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(OCTETS)
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _spans(kind: str, found: str, pieces: str, strict: bool) -> Column:
    """Structs of the matches in column ``found``: where they stand, what the labelers say.

    Starts are sums of lengths before, by blocks of ``BLOCK`` matches and then within the block, so
    that a text of very many numbers doesn't take the square of their count."""
    f, p = F.col(found), F.col(pieces)
    sizes = F.col(f"{found}_sizes")
    sums = F.col(f"{found}_sums")

    def one(x: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        before = F.aggregate(F.slice(sizes, block * BLOCK + 1, i % BLOCK), F.lit(0), lambda a, b: a + b)
        start = F.element_at(sums, block + 1) + before + F.length(F.element_at(p, i + 1))
        left, right = F.substring(F.element_at(p, i + 1), -40, 40), F.substring(F.element_at(p, i + 2), 1, 1)
        ok = _valid(kind, x) if strict or kind == "card" else F.lit(True)
        border = ~left.rlike(BEFORE[kind]) & ~right.rlike(r"^[A-Za-z0-9]")
        return F.struct(
            start.alias("start"), F.lit(ALL.index(kind)).alias("kind"), (start + F.length(x)).alias("end"), (ok & F.lit(strict)).alias("base"),
            # votes: for, 1; against, 0; abstaining, null is -1
            F.when(ok, 1 if strict else -1).otherwise(0).alias("v_pattern"),
            F.when(x.rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("v_gazetteer"),
            F.when(left.rlike(CONTEXT[kind]), 1).otherwise(-1).alias("v_context"),
            F.when(border, 1).otherwise(0).alias("v_border"),
            F.when(left.rlike(AGAINST[kind]), 0).otherwise(-1).alias("v_against"),
            F.when(x.rlike(SHAPE[kind]), 1).otherwise(0).alias("v_shape"),
        )

    return F.transform(f, one)


def _with_sums(df: DataFrame, found: str, pieces: str) -> DataFrame:
    """Length of each match with the piece before it, and sums of these before each block."""
    df = df.withColumn(f"{found}_sizes", F.transform(F.col(found), lambda x, i: F.length(x) + F.length(F.element_at(F.col(pieces), i + 1))))
    s = F.col(f"{found}_sizes")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(s, b * BLOCK + 1, BLOCK), F.lit(0), lambda a, x: a + x))
    zero = F.struct(F.lit(0).alias("sum"), F.array(F.lit(0)).alias("all"))
    sums = F.aggregate(blocks, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")), lambda a: a["all"])
    return df.withColumn(f"{found}_sums", sums)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, and an array of all candidate spans."""
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sources = [(k, STRICT[k], True) for k in KINDS] + [(k, pattern, False) for k, pattern in WIDE]
    names = [f"_f{i}" for i in range(len(sources))]
    df = df.select("_id", *[c for n, (kind, pattern, _) in zip(names, sources, strict=True) for c in (lambda m: (m[0].alias(n), m[1].alias(f"{n}p")))(_matches(F.col("_text"), kind, pattern))])
    for n in names:
        df = _with_sums(df, n, f"{n}p")
    spans = [_spans(kind, n, f"{n}p", strict) for n, (kind, _, strict) in zip(names, sources, strict=True)]
    return df.select("_id", F.concat(*spans).alias("_c"))


VOTES = ("v_pattern", "v_gazetteer", "v_context", "v_border", "v_against", "v_shape")


def reconcile(counts: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]]]:
    """Expectation-maximisation over (votes, count): the probability of each vote pattern that its span is personal data, and each labeler's rates of voting "for" on true and on other spans (abstaining says nothing). Starts from the majority."""
    total = sum(n for _, n in counts)
    post = {v: (1 + sum(x == 1 for x in v)) / (2 + sum(x >= 0 for x in v)) for v, _ in counts}
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        prior = min(0.99, max(0.01, sum(post[v] * n for v, n in counts) / max(total, 1)))
        rates = []
        for j in range(len(VOTES)):
            for_true = sum(post[v] * n for v, n in counts if v[j] == 1) + 1
            against_true = sum(post[v] * n for v, n in counts if v[j] == 0) + (0.2 if j != 4 else 2)
            for_other = sum((1 - post[v]) * n for v, n in counts if v[j] == 1) + 0.2
            against_other = sum((1 - post[v]) * n for v, n in counts if v[j] == 0) + 1
            rates.append((for_true / (for_true + against_true), for_other / (for_other + against_other)))
        for v, _ in counts:
            odds = math.log(prior / (1 - prior))
            for j, x in enumerate(v):
                t, o = rates[j]
                if x >= 0:
                    odds += math.log((t if x else 1 - t) / (o if x else 1 - o))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


def features(kind: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(ALL))), *(float(x == 1) for x in votes), *(float(x == 0) for x in votes)]


def fit(rows: list[tuple[int, tuple[int, ...], float, float]], rounds: int = 300, rate: float = 0.5) -> list[float]:
    """Logistic regression of (kind, votes, count, probability) by gradient ascent, each row weighted by the logarithm of its count."""
    data = [(features(k, v), math.log1p(n), p) for k, v, n, p in rows]
    w = [0.0] * len(features(0, (0,) * len(VOTES)))
    total = sum(n for _, n, _ in data) or 1.0
    for _ in range(rounds):
        grad = [-0.001 * x for x in w]
        for f, n, p in data:
            err = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f, strict=True))))))) * n / total
            for i, x in enumerate(f):
                grad[i] += err * x
        w = [a + rate * g for a, g in zip(w, grad, strict=True)]
    return w


def train(found: DataFrame) -> list[float]:
    """Weights of the span classifier from the candidates of all documents."""
    span = found.select(F.explode("_c").alias("s")).select("s.kind", *(f"s.{v}" for v in VOTES))
    rows = [(r.kind, tuple(r[v] for v in VOTES), float(r.n)) for r in span.groupBy("kind", *VOTES).agg(F.count(F.lit(1)).alias("n")).collect()]
    rows.sort()
    by_votes: dict[tuple[int, ...], float] = {}
    for _, v, n in rows:
        by_votes[v] = by_votes.get(v, 0.0) + n
    post, _ = reconcile(sorted(by_votes.items()))
    return fit([(k, v, n, post[v]) for k, v, n in rows])


def _accepted(s: Column, w: list[float]) -> Column:
    """Probability of at least 0.5: in weights, a sum above zero. Spans without a strict pattern need a gazetteer or context that speaks for them."""
    terms = [F.lit(w[0]), F.element_at(F.array(*map(F.lit, w[1 : 1 + len(ALL)])), s["kind"] + 1)]
    n = len(ALL) + 1
    for j, v in enumerate(VOTES):
        terms.append(F.when(s[v] == 1, w[n + j]).when(s[v] == 0, w[n + len(VOTES) + j]).otherwise(0.0))
    evident = (s["kind"] < len(KINDS)) | (s["v_gazetteer"] == 1) | (s["v_context"] == 1)
    return (reduce(lambda a, b: a + b, terms) > 0) & (s["v_pattern"] == -1) & (s["v_border"] == 1) & evident


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _decided(found: DataFrame, w: list[float]) -> DataFrame:
    """The id, ``base`` and ``spans``: arrays of (start, kind, end), sorted."""
    plain = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    split = found.select("_id", F.filter("_c", lambda s: s["base"]).alias("_b"), F.filter("_c", lambda s: ~s["base"] & _accepted(s, w)).alias("_a"))
    free = F.filter("_a", lambda s: ~F.exists("_b", lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return split.select("_id", plain(F.col("_b")).alias("base"), F.array_distinct(plain(F.concat("_b", free))).alias("spans"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """Per row: the id, ``base`` and ``spans``: arrays of (start, kind, end), sorted; kind is a place in ALL."""
    found = materialise(candidates(docs, id_col, text_col), "pii_candidates")
    w = weights if weights is not None else train(found)
    out = _decided(found, w)
    return out.select(F.col("_id").alias(id_col), "base", "spans")


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, the digest of the base spans, all spans as text; then how many spans and secrets there are in all."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == ALL.index("secret"))).cast("long").alias("n_secret")
    return spans.select(id_col, *map(count, KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), secrets)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets; other columns unchanged. Overlapping spans are masked as one, named after the first. The rows are written once with their candidates, which training and masking read: a filter on the candidates, or a second pass, would search all texts anew."""
    found = materialise(candidates(docs.withColumn("_row", F.struct(*docs.columns)), "_row", text_col), "pii_rows")
    w = train(found)
    rows = _decided(found, w).select("_id", F.col("spans").alias("_s")).withColumn("_text", F.col(f"_id.{text_col}"))
    names = F.array(*[F.lit(f"<{k}>") for k in ALL])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        # a span that begins within what is masked already only widens it
        kept = F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.substring(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), kept.alias("out"))

    done = F.aggregate("_s", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("_text"), a["at"] + 1, F.length("_text"))))
    masked = F.when(F.size("_s") == 0, F.col("_text")).otherwise(done)
    return rows.select(*[masked.alias(c) if c == text_col else F.col("_id").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_spans(table(spark, sf_dir, "documents")))
