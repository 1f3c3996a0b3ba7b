"""Personal data: candidate spans and boosted trees. DataFrame functions only.

Base kinds (email, ip, card, phone) are found by their patterns and checks. High-recall generators
propose more spans, overlapping ones too, and secrets. Each candidate has discrete format and context
features; all candidates of the corpus are counted by feature vector and fold, a table no longer than
the feature space, and trees are boosted on these counts, the same as on the candidates one by one.
Training marks are weak ones: a candidate is positive if it covers an accepted base span, or if a
word of its kind's (CONTEXT) stands right before it, for secrets with an assignment; the trees don't
see the words that make a mark. Limits are set on candidates that touch no base span, since only these can be
added: scored by trees that didn't learn from their fold, each kind gets the least score at which
precision reaches PRECISION, midway to the next lower one, but not below even odds; a kind without such
a score adds nothing. A candidate is compared with all base spans of its text.
Candidates above it that touch no base span are added.

Positions are code points, ends exclusive. Defined cases: null and empty texts have no spans;
repeated rows each get their row; without candidates nothing is learnt and nothing added; equal
spans of a kind are one; added spans of a kind may overlap those of another.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked, stored

KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed values of the contract, with run starts and possessive runs so that time stays linear; \p{Alnum} is [A-Za-z0-9], and faster.
_LOCAL = "[\\p{Alnum}._%+-]"
BASE = {
    "email": f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[\\p{{Alnum}}-]++(?:\\.[\\p{{Alnum}}-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Generators: wide patterns whose matches may overlap each other and base spans.
WIDE = {
    "email": "(?<![^\\s@])[^\\s@]++@[^\\s@]++|(?<![\\p{Alnum}._%+-])[\\p{Alnum}._%+-]++\\x20?[\\[(](?:at|AT)[\\])]\\x20?[\\p{Alnum}-]++(?:\\x20?(?:\\.|[\\[(](?:dot|DOT)[\\])])\\x20?[\\p{Alnum}-]++)++",
    "ip": "(?<![0-9.])[0-9]++(?:\\.[0-9]++){2,}+",
    "card": "(?<![0-9])[0-9](?:[\\x20.-]{0,2}[0-9]){11,}+",
    "phone": "(?<![0-9])\\+?\\(?[0-9](?:[\\x20().-]{0,3}[0-9]){6,14}+(?![0-9])",
    "secret": "(?<![\\p{Alnum}_+/-])[\\p{Alnum}_+/-]{20,}+",
}
#: Words before a candidate that mark it, up to its begin.
CONTEXT = {
    "email": "(?i)(?:e-?mail|mailto|contact|write to)[^A-Za-z0-9]{0,4}$",
    "ip": "(?i)(?:host|server|addr(?:ess)?|\\bip)[^A-Za-z0-9]{0,4}$",
    "card": "(?i)(?:card|visa|mastercard|amex|iban|account)(?:\\x20?(?:no|number|nr)\\.?)?[^A-Za-z0-9]{0,4}$",
    "phone": "(?i)(?:call|phone|tel|fax|mobile|cell)(?:\\x20?(?:no|number|nr)\\.?)?[^A-Za-z0-9]{0,4}$",
    "secret": "(?i)(?:token|secret|passw(?:or)?d|api.?key|credentials?)[\"'`]?\\s*[=:]\\s*[\"'`]?$",
}
FEATURES = ("kind", "digits", "length", "plus", "dots", "seps", "mixed", "check", "opened", "edge")
ROUNDS, DEPTH, RATE = 20, 3, 0.3
PRECISION, FOLDS = 0.99, 5
_CHUNK = 256


def spans(text: Column, pattern: str, may: Column | None = None) -> Column:
    """array<start long, end long, m string, before string>: the pattern's matches in order; none unless may holds.

    Positions are running sums over the pieces between matches, in chunks, so that long texts with
    very many matches don't take the square of their number."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("m"))
    sized = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["p"]).cast("long").alias("p"), F.length(x["m"]).cast("long").alias("n"), x["m"].alias("m"), F.right(x["p"], F.lit(24)).alias("before")))
    kind = "array<struct<start:bigint,end:bigint,m:string,before:string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["p"]
        one = F.struct(a.alias("start"), (a + x["n"]).alias("end"), x["m"].alias("m"), x["before"].alias("before"))
        return F.struct((a + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunks(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _CHUNK).cast("int")), lambda c: F.aggregate(F.slice(all_, c * _CHUNK + 1, F.lit(_CHUNK)), start, step))
        whole = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def move(acc: Column, c: Column) -> Column:
            moved = F.transform(c["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["m"].alias("m"), s["before"].alias("before")))
            return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

        return F.flatten(F.aggregate(cut, whole, move)["out"])

    some = text.rlike(pattern) if may is None else may & text.rlike(pattern)
    return F.when(some, chunks(sized)).otherwise(F.array().cast(kind))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.coalesce(d.try_cast("int") if hasattr(d, "try_cast") else d.cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def accepted(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return ~F.exists(F.split(m, "\\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) > 3) & ~F.exists(F.split(m, "\\."), lambda p: F.right(p, F.lit(9)).cast("int") > 255)
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(digits(m))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _features(kind: str, c: Column) -> list[Column]:
    m, before = c["m"], c["before"]
    n = F.length(digits(m))
    flag = lambda x: x.cast("int")
    return [
        F.lit(KINDS.index(kind)),
        F.when(n < 7, F.floor(n / 3)).when(n < 20, n - 4).otherwise(16).cast("int"),
        F.least(F.floor(F.length(m) / 8), F.lit(6)).cast("int"),
        flag(m.startswith("+")),
        F.least(F.length(F.regexp_replace(m, "[^.]", "")), F.lit(4)),
        F.least(F.length(F.regexp_replace(m, "[^ ()-]", "")), F.lit(4)),
        flag(m.rlike("[A-Za-z]") & (n > 0)) + flag(m.rlike("^[0-9a-f]+$")),
        flag(n.between(14, 19) & F.when(n.between(14, 19), luhn(digits(m))).otherwise(False)) if kind == "card" else F.lit(0),
        flag(before.rlike("[\"'`<(\\[]$")),
        flag(before.rlike("[A-Za-z0-9]$")) if kind != "email" else flag(m.rlike("[.,;:)]$")),
    ]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array<start, end, kind>), wide (array<start, end, features..., mark, free, fold>), stored."""
    text = F.col("text")
    rows = picked(docs, id_col, text_col).withColumns({"at": text.contains("@"), "digit": text.rlike("[0-9]")})
    # What a match can't do without; most texts have none of it, and the patterns needn't be tried.
    need = {"email": F.col("at"), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.col("digit")}
    wide_need = need | {"email": F.col("at") | text.rlike("[\\[(](?:at|AT)[\\])]"), "secret": None}
    found = rows.select("doc_id", *(spans(text, p, need[k]).alias(f"b_{k}") for k, p in BASE.items()), *(spans(text, p, wide_need[k]).alias(f"w_{k}") for k, p in WIDE.items()))

    def kept(kind: str) -> Column:
        good = F.filter(F.col(f"b_{kind}"), lambda c: accepted(kind, c["m"]))
        return F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind")))

    based = found.withColumn("base", F.array_sort(F.concat(*map(kept, BASE)))).drop(*(f"b_{k}" for k in BASE))

    def wide(kind: str) -> Column:
        def one(c: Column) -> Column:
            near = F.filter("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            covers = F.exists(near, lambda b: (b["kind"] == KINDS.index(kind)) & (b["start"] >= c["start"]) & (b["end"] <= c["end"]))
            mark = c["before"].rlike(CONTEXT[kind]) | covers
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), *(f.alias(n) for n, f in zip(FEATURES, _features(kind, c), strict=True)), mark.cast("int").alias("mark"), (F.size(near) == 0).alias("free"), F.pmod(F.xxhash64(c["m"]), F.lit(FOLDS)).cast("int").alias("fold"))

        return F.transform(f"w_{kind}", one)

    return stored(based.select("doc_id", "base", F.concat(*map(wide, WIDE)).alias("wide")), "pii-candidates")


class Trees:
    """Boosted regression trees for the logistic loss over weighted cells of small integers."""

    def __init__(self, x: np.ndarray, positive: np.ndarray, total: np.ndarray):
        p = np.clip(positive.sum() / max(total.sum(), 1), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(len(x), self.start)
        for _ in range(ROUNDS):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(x, positive - total * q, total * q * (1 - q), np.arange(len(x)), DEPTH)
            self.trees.append(tree)
            score += self._value(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int) -> tuple | float:
        gs, hs = g[at].sum(), h[at].sum() + 1.0
        best, split = 1e-3, None
        for f in range(x.shape[1] if depth else 0):
            size = int(x[:, f].max()) + 1
            left_g = np.cumsum(np.bincount(x[at, f], g[at], size))[:-1]
            left_h = np.cumsum(np.bincount(x[at, f], h[at], size))[:-1] + 1.0
            if len(left_g):
                gain = left_g**2 / left_h + (gs - left_g) ** 2 / (hs - left_h + 2.0) - gs**2 / hs
                if gain.max() > best:
                    best, split = float(gain.max()), (f, int(gain.argmax()))
        if split is None:
            return float(RATE * gs / hs)
        low = x[at, split[0]] <= split[1]
        return (*split, self._grow(x, g, h, at[low], depth - 1), self._grow(x, g, h, at[~low], depth - 1))

    def _value(self, tree: tuple | float, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._value(tree[2], x), self._value(tree[3], x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """In the order of column(), so that both give the same floating-point number."""
        out = np.full(len(x), self.start)
        for t in self.trees:
            out = out + self._value(t, x)
        return out

    def column(self, of: list[Column]) -> Column:
        """The score as a Spark expression."""

        def expr(tree: tuple | float) -> Column:
            return F.lit(tree) if isinstance(tree, float) else F.when(of[tree[0]] <= tree[1], expr(tree[2])).otherwise(expr(tree[3]))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + expr(t)
        return out


def fit(found: DataFrame) -> tuple[Trees, dict[int, float]] | None:
    """Trees and limits by kind; the rows that reach the driver are cells of the feature space."""
    cells = found.select(F.explode("wide").alias("c")).groupBy(*(F.col(f"c.{f}").alias(f) for f in (*FEATURES, "fold", "free"))).agg(F.sum("c.mark").alias("positive"), F.count("*").alias("total")).orderBy(*FEATURES, "fold", "free").collect()
    if not cells:
        return None
    x = np.array([[r[f] for f in FEATURES] for r in cells], np.int64)
    positive, total = (np.array([r[n] for r in cells], np.float64) for n in ("positive", "total"))
    fold, free = np.array([r["fold"] for r in cells]), np.array([r["free"] for r in cells])
    score = np.full(len(x), -np.inf)
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            score[fold == k] = Trees(x[fold != k], positive[fold != k], total[fold != k]).scores(x[fold == k])
    limits = {}
    for kind in range(len(KINDS)):
        at = np.flatnonzero((x[:, 0] == kind) & free & np.isfinite(score))
        steps = np.unique(score[at])
        for n, limit in enumerate(steps):
            over = score[at] >= limit
            if positive[at][over].sum() >= PRECISION * total[at][over].sum():
                limits[kind] = max(0.0, float((limit + steps[n - 1]) / 2) if n else float(limit))
                break
    return Trees(x, positive, total), limits


def _listed(items: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(items), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans (kind:start:end by start, then kind), n_spans and n_added
    (spans in all, and those that the trees add); one row for each row of docs."""
    found = candidates(docs, id_col, text_col)
    model = fit(found)
    by_kind = lambda x: F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = by_kind(F.col("base"))
    extra = F.slice(base, 1, 0)
    if model:
        trees, limits = model

        def good(c: Column) -> Column:
            limit = F.lit(None).cast("double")
            for kind, least in limits.items():
                limit = F.when(c["kind"] == kind, F.lit(least)).otherwise(limit)
            return F.coalesce(c["free"] & (trees.column([c[f] for f in FEATURES]) >= limit), F.lit(False))

        extra = F.array_distinct(by_kind(F.filter("wide", good)))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), _listed(base).alias("base_spans"), _listed(F.concat(base, extra)).alias("spans"), F.size(F.concat(base, extra)).cast("long").alias("n_spans"), F.size(extra).cast("long").alias("n_added"))


def redacted(text: Column, listed: Column) -> Column:
    """text with every span of a spans column replaced by its kind in brackets; overlapping spans become one."""
    parts = F.transform(F.filter(F.split(listed, ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        a, b = s[1].cast("int"), s[2].cast("int")
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, a - acc["at"]), F.lit("["), s[0], F.lit("]"))
        return F.struct(F.greatest(b, acc["at"]).alias("at"), F.when(a >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(parts, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
