"""Personal data by candidates and boosted trees, in DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm._common import cut

#: What the base kinds are, as the contract's patterns find them. The look-behinds and possessive loops change no match:
#: they keep long runs from being tried at each of their places, and Java from recursing.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators, of 16 to 19 digits; shorter and longer runs are failing matches
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GATE = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: High-recall generators; their spans may overlap those of any kind. Possessive, and started at the edge of a word, so that long texts cost their length.
LOOSE = {
    "contact": r"(?<![^\s@<>,;|])[^\s@<>,;|]++@[^\s@<>,;|]++",
    "spelt": rf"(?i)(?<![{LOCAL}])[{LOCAL}]++(?:\s?[\[({{]\s?at\s?[\])}}]\s?[a-z0-9-]++(?:(?:\s?[\[({{]\s?dot\s?[\])}}]\s?|\.|\sdot\s)[a-z0-9-]++)++|\sat\s[a-z0-9-]++(?:\sdot\s[a-z0-9-]++)++)",
    "number": r"(?<![0-9A-Za-z])\+?\(?[0-9]++(?:[ ().-]{1,2}+[0-9]++)*+",
    "secret": r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=-]{16,}+",
}
LEAST_DIGITS = 7  # of a number
CONTEXT = 24  # characters in front of a candidate that count as its context
CUE = r"(?i)(?:tel|phone|call|fax|mobil|mail|contact|card|visa|account|ssn|iban|passport|host|user|login)[a-z]*[^a-z]{0,4}$"
KEY = r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|auth|bearer|credential)[a-z]*[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$"
AT = r"(?i)@|[\[({]\s?at\s?[\])}]|\sat\s"
AT_FIRST = r"(?i)^.*?(?:@|[\[({]\s?at\s?[\])}]|\sat\s)"
FEATURES = ("contact", "number", "secret", "digits", "letters", "marks", "groups", "plus", "at", "host_dots", "brackets", "luhn", "cue_before", "key_before", "letter_after", "longest", "turns", "distinct")
UNSURE = 0.1  # weight of a candidate that nothing confirms, as an example of what isn't real
PLACE = "array<struct<s:int,e:int>>"


def spans_of(text: Column, hits: Column, gaps: Column) -> Column:
    """array<struct<s, e, m>>: places in code points of the hits, from the lengths of hits and of the gaps between them."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    step = lambda a, x: F.struct((a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["g"])).alias("s"), (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e"), x["m"].alias("m")))).alias("out"))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("m"))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])).otherwise(none)


def find(rows: DataFrame, patterns: dict[str, str], gates: dict, text: str = "body") -> DataFrame:
    """rows with one column of spans for each pattern, named s_<kind>."""
    t = F.col(text)
    hits, gaps = {}, {}
    for kind, rx in patterns.items():
        gate = gates.get(kind)
        on = t.contains(gate) if gate else F.lit(True)
        hits[f"h_{kind}"] = F.when(on, F.regexp_extract_all(t, F.lit(rx), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns(hits)
    for kind, rx in patterns.items():
        gaps[f"g_{kind}"] = F.when(F.size(f"h_{kind}") > 0, F.split(t, rx, -1))
    rows = rows.withColumns(gaps)
    rows = rows.withColumns({f"s_{kind}": spans_of(t, F.col(f"h_{kind}"), F.col(f"g_{kind}")) for kind in patterns})
    return rows.drop(*hits, *gaps)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by 10."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    parts = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value)
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def holds(kind: str, m: Column) -> Column:
    """The checks that a match of the kind must pass."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _part)
    if kind == "card":
        return luhn(only_digits(m))
    if kind == "phone":
        return F.length(only_digits(m)).between(8, 15)
    return F.lit(True)


def _part(p: Column) -> Column:
    low = F.regexp_replace(p, "^0+", "")
    return (low == "") | ((F.length(low) <= 3) & (F.when(F.length(low) <= 3, low).cast("int") <= 255))


def passes(kind: str):
    return lambda span: holds(kind, span["m"])


def features(kind: str, before: Column, m: Column, after: Column) -> Column:
    """The FEATURES of a candidate: of its format and of what stands around it."""
    d = only_digits(m)
    count = lambda rx: F.length(m) - F.length(F.regexp_replace(m, rx, ""))
    parts = F.split(m, "[^A-Za-z0-9]+")
    x = [
        F.lit(int(kind in ("contact", "spelt"))), F.lit(int(kind == "number")), F.lit(int(kind == "secret")),
        F.length(d), count("[A-Za-z]"), count("[^A-Za-z0-9]"), F.size(parts), m.startswith("+").cast("int"), F.regexp_count(m, F.lit(AT)),
        F.regexp_count(F.regexp_replace(m, AT_FIRST, ""), F.lit(r"(?i)\.|[\[({]\s?dot\s?[\])}]|\sdot\s")), count(r"[()]"), F.when(F.length(d).between(12, 24), luhn(d).cast("int")).otherwise(0), before.rlike(CUE).cast("int"),
        before.rlike(KEY).cast("int"), after.rlike("^[A-Za-z]").cast("int"), F.array_max(F.transform(parts, lambda p: F.length(p))),
        F.size(F.split(m, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")), F.size(F.array_distinct(F.split(F.lower(F.substring(m, 1, 64)), ""))),
    ]
    # how long the words of an address are says nothing of it
    blank = ("digits", "letters", "marks", "groups", "longest", "distinct", "turns") if kind in ("contact", "spelt") else ()
    return F.array(*[F.lit(0.0) if name in blank else F.coalesce(v.cast("double"), F.lit(0.0)) for name, v in zip(FEATURES, x)])


def measured(kind: str, text: Column, span: Column) -> Column:
    """struct<s, e, x, b, m, a>: the features of a candidate, what stands before it, itself, and what follows."""
    before = F.substring(text, F.greatest(F.lit(1), span["s"] - CONTEXT + 1), F.least(F.lit(CONTEXT), span["s"]))
    after = F.substring(text, span["e"] + 1, F.lit(1))
    return F.struct(span["s"].alias("s"), span["e"].alias("e"), features(kind, before, span["m"], after).alias("x"), before.alias("b"), span["m"].alias("m"), after.alias("a"))


def proposed(kind: str, m: Column) -> Column:
    """What a generator's match must hold to be a candidate at all."""
    if kind == "number":
        return F.length(only_digits(m)) >= LEAST_DIGITS
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]") if kind == "secret" else F.lit(True)


def candidates(rows: DataFrame) -> DataFrame:
    """rows (with body) and base, loose: base spans of each kind that passed, and measured candidates."""
    kept_columns = rows.columns
    rows = find(rows, BASE, GATE)
    rows = find(rows, LOOSE, {"contact": "@"})
    kept = {k: F.filter(f"s_{k}", passes(k)) for k in BASE}
    base = F.struct(*[F.transform(v, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"))).cast(PLACE).alias(k) for k, v in kept.items()])
    fit = lambda k: lambda s: proposed(k, s["m"])
    look = lambda k: lambda s: measured(k, F.col("body"), s)
    loose = F.struct(*[F.transform(F.filter(f"s_{k}", fit(k)), look(k)).alias(k) for k in LOOSE])
    return rows.select(*kept_columns, base.alias("base"), loose.alias("loose"))


def meets(base: Column, span: Column) -> Column:
    """Whether a span overlaps a base span of any kind."""
    return F.exists(F.concat(*[base[k] for k in BASE]), lambda b: (b["s"] < span["e"]) & (span["s"] < b["e"]))


def examples(kind: str, c: Column, base: Column) -> Column:
    """array<struct<kind, x, label, weight, kept>> that a candidate teaches: itself, disguises of a real one, counterfeits of it.

    Where a kind has several disguises or counterfeits, the last form of each is
    ``kept`` from the fit: only the thresholds see it.

    A candidate is real if a base span confirms it or, for secrets and numbers,
    a cue word in front of it does. A disguise is the same thing in a form the
    base patterns miss: an address spelt out, a phone number without its plus,
    a number or secret without its cue. A counterfeit looks like it and is none:
    a card number with another last digit, a short number, a user at a host
    without a dot, words joined to an identifier, one group over and over. What
    nothing confirms may still be real: it counts as not real with the weight UNSURE.
    """
    b, m, a = c["b"], c["m"], c["a"]
    nothing = F.lit("")
    base_real = meets(base, c)
    real = base_real | (b.rlike(KEY) if kind == "secret" else b.rlike(CUE) if kind == "number" else F.lit(False))
    own = [(b, m, a)]
    d = only_digits(m)
    if kind in ("contact", "spelt"):
        # the same with a short local part and host, as "a [at] b [dot] c"
        short = F.regexp_replace(F.regexp_replace(m, r"^[^@]*\.", ""), r"@[^.]+\.(?=[^.]+\.)", "@")
        spell = lambda what, x, y: F.regexp_replace(F.regexp_replace(what, r"\.", x), "@", y)
        forms = ((" dot ", " at "), (" [dot] ", " [at] "), (".", "(at)"))
        disguised = [(b, spell(what, x, y), a) for what in (m, short) for x, y in forms] if kind == "contact" else []
        fake = [(b, F.regexp_replace(m, r"@.*", "@host"), a)] if kind == "contact" else []
        kinds = [kind, *["spelt"] * len(disguised), *["contact"] * len(fake)]
    elif kind == "number":
        disguised = [(nothing, F.regexp_replace(m, r"^\+", ""), a), (b, F.regexp_replace(m, r"^\+[0-9]+[ .-]?", ""), a), (nothing, F.regexp_replace(m, r"[ ()-]+", "."), a)]
        last = F.substring(d, -1, 1)
        wrong = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), (F.pmod(last.cast("int") + 1, F.lit(10))).cast("string"))
        fake = [(nothing, wrong, nothing), (nothing, F.substring(d, 1, 7), nothing), (nothing, F.concat_ws(".", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)), nothing), (nothing, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)), nothing)]
        kinds = [kind] * (1 + len(disguised) + len(fake))
    else:
        other = F.regexp_replace(F.base64(F.unhex(F.sha2(m, 256))), "[+/=]", "")  # as random, in other letters
        disguised = [(nothing, m, a), (nothing, F.upper(m), nothing), (nothing, F.substring(other, 1, 32), nothing), (nothing, F.substring(other, 5, 20), nothing)]
        words = F.regexp_replace(F.trim(b), "[^A-Za-z0-9]+", "-")
        fake = [(nothing, F.repeat(F.substring(m, 1, 3), 7), nothing), (nothing, F.concat_ws("-", words, F.substring(d, 1, 4)), nothing), (nothing, F.concat(F.lit("2024-01-01_"), F.regexp_replace(words, "[0-9]", "")), nothing)]
        kinds = [kind] * (1 + len(disguised) + len(fake))
    labels = [real, *[F.lit(True)] * len(disguised), *[F.lit(False)] * len(fake)]
    # only what is real is disguised; where the disguise or counterfeit is no candidate of its generator it teaches nothing
    fits = [F.lit(True), *[real & proposed(k, x[1]) & F.rlike(x[1], F.lit(LOOSE[k])) for k, x in zip(kinds[1:], [*disguised, *fake])]]
    weights = [F.when(real, 1.0).otherwise(UNSURE), *[F.lit(1.0)] * len(fits[1:])]
    kept = [False] + [i == n - 1 and n > 1 for n in (len(disguised), len(fake)) for i in range(n)]
    rows = [F.when(ok, F.struct(F.lit(k).alias("kind"), features(k, *x).alias("x"), y.cast("double").alias("label"), w.alias("weight"), F.lit(h).alias("kept"))) for k, x, y, ok, w, h in zip(kinds, [*own, *disguised, *fake], labels, fits, weights, kept)]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def tree_value(node, x: Column) -> Column:
    """A fitted tree as nested conditions on the features."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[split.featureIndex()] <= F.lit(float(split.threshold())), tree_value(node.leftChild(), x)).otherwise(tree_value(node.rightChild(), x))


class Chooser:
    """Boosted trees over candidates, and for each kind the threshold at which they are precise enough.

    curve holds (kind, threshold, precision, recall, examples) at each step, over
    the documents that the fit didn't see, with forms of disguises and
    counterfeits that it didn't see either.
    """

    def __init__(self, found: DataFrame, sample: int = 20_000, precision: float = 0.98, rounds: int = 12, depth: int = 4, seed: int = 11):
        self.trees, self.thresholds, self.curve = [], {}, []
        fold = F.pmod(F.xxhash64("id"), F.lit(10))
        teach = lambda k: lambda c: examples(k, c, F.col("base"))
        taught = F.concat(*[F.flatten(F.transform(f"loose.{k}", teach(k))) for k in LOOSE])
        rows = found.select(fold.alias("fold"), F.xxhash64("id", "loose").alias("h"), F.posexplode(taught).alias("at", "r")).select("fold", F.xxhash64("h", "at").alias("h"), "r.*")
        rows = cut(rows, "pii-examples")
        learn = rows.where("fold < 7 AND NOT kept").drop("kept")
        # a bounded sample for the fit, the same number of each kind; thresholds see every held-out example
        some = None
        for k in LOOSE:
            part = learn.where(F.col("kind") == k).orderBy("h").limit(sample // len(LOOSE))
            some = part if some is None else some.unionByName(part)
        some = cut(some, "pii-sample")
        if some.select("label").distinct().count() < 2:
            return
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, featuresCol="v", weightCol="weight").fit(some.select(array_to_vector("x").alias("v"), "label", "weight"))
        self.trees = list(zip([t._call_java("rootNode") for t in model.trees], model.treeWeights))
        steps = [i / 20 for i in range(1, 20)] + [0.97, 0.98, 0.99]
        held = rows.where("fold >= 7").select("kind", self.chance(F.col("x")).alias("p"), (F.col("label") * F.col("weight")).alias("right"), "weight")
        at = F.explode(F.array(*[F.lit(0.0), *[F.lit(t) for t in steps]]))
        counts = held.select("kind", at.alias("t"), "p", "right", "weight").where("p >= t").groupBy("kind", "t").agg(F.sum("right").alias("right"), F.sum("weight").alias("all"), F.count(F.lit(1)).alias("n")).collect()
        real = {r.kind: r.right for r in counts if r.t == 0.0}
        self.curve = sorted((r.kind, r.t, r.right / r["all"], r.right / real[r.kind], r.n) for r in counts if r.t > 0.0 and real[r.kind] > 0)
        for kind in LOOSE:
            # precision counts twice as much as recall (F at 0.5): what is redacted wrongly is lost
            good = [(t, 1.25 * right * recall / (0.25 * right + recall)) for k, t, right, recall, n in self.curve if k == kind and right >= precision and recall > 0 and n >= 5]
            if good:
                # of the best steps the middle one: as far from what it must take as from what it must not
                best = [t for t, f in good if f >= max(x for _, x in good) - 1e-9]
                self.thresholds[kind] = best[(len(best) - 1) // 2]

    def chance(self, x: Column) -> Column:
        raw = sum((tree_value(node, x) * F.lit(float(w)) for node, w in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * raw))

    def chosen(self) -> Column:
        """struct of spans by kind: candidates that the trees take, that no base span covers already and no likelier candidate of another kind."""
        held = "array<struct<s:int,e:int,p:double,k:int>>"
        base = F.col("base")
        scored = lambda i: lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), self.chance(c["x"]).alias("p"), F.lit(i).alias("k"))
        taken = lambda least: lambda c: (c["p"] >= least) & ~meets(base, c)
        parts = [F.filter(F.transform(f"loose.{kind}", scored(i)), taken(self.thresholds[kind])).cast(held) for i, kind in enumerate(LOOSE) if kind in self.thresholds]
        if not parts:
            return F.struct(*[F.array().cast(PLACE).alias(k) for k in LOOSE])
        every = F.concat(*parts)
        better = lambda c: lambda o: (o["k"] != c["k"]) & (o["s"] < c["e"]) & (c["s"] < o["e"]) & ((o["p"] > c["p"]) | ((o["p"] == c["p"]) & (o["k"] < c["k"])))
        best = F.filter(every, lambda c: ~F.exists(every, better(c)))
        of = lambda i: lambda c: c["k"] == i
        return F.struct(*[F.transform(F.filter(best, of(i)), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))).cast(PLACE).alias(k) for i, k in enumerate(LOOSE)])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, base, added) for each row: struct of arrays of (s, e) by kind, places in code points, ends exclusive.

    Base spans are those of the BASE patterns, leftmost and not overlapping
    within a kind, that pass the kind's check. Loose generators (LOOSE) propose
    more, overlapping ones too. Boosted trees learn which of them are personal
    data or secrets from their format and context, on at most ``sample``
    examples: candidates that base spans or cue words confirm, the same in
    disguises that the base patterns miss, and counterfeits (see examples). Each
    kind has a threshold at which the trees reach ``precision`` on all examples
    of held-out documents, among them forms that no fitted example has, and of
    such thresholds the one with the best F at 0.5 (see Chooser.curve); what they take
    is added, base spans always stay. Secrets have at least 16 letters, numbers
    at least LEAST_DIGITS digits. Too few
    examples: nothing is added. Null texts are empty; only id and text are read,
    whatever other columns are called. Repeated rows give repeated results; an
    empty table gives an empty table. The text is read once, in built-in
    functions; nothing is shuffled but the sample.
    """
    found = cut(candidates(_rows(docs, id_col, text_col)).drop("body"), "pii-candidates")
    chooser = Chooser(found, **options)
    return found.select(F.col("id").alias(id_col), "base", chooser.chosen().alias("added"))


def listed(spans: Column, kinds) -> Column:
    """kind:start:end for each span, by kind, then start."""
    named = lambda kind: lambda s: F.concat_ws(":", F.lit(kind), s["s"].cast("string"), s["e"].cast("string"))
    return F.concat(*[F.transform(F.array_sort(spans[k]), named(k)) for k in kinds])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "█", **options) -> DataFrame:
    """docs with each base or added span replaced by as many marks.

    The spans are found beside the text they belong to, without a join: rows
    with null or repeated ids are redacted like any other, null texts stay null,
    and other columns are carried, whatever their names.
    """
    chooser = Chooser(cut(candidates(_rows(docs, id_col, text_col)).drop("body"), "pii-candidates"), **options)
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    found = candidates(whole).withColumn("added", chooser.chosen())
    every = F.array_sort(F.concat(*[F.col(f"base.{k}") for k in BASE], *[F.col(f"added.{k}") for k in LOOSE]))
    body = F.col("body")
    covered = F.aggregate(
        every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["e"] <= a["at"], a).otherwise(F.struct(s["e"].alias("at"), F.concat(a["out"], F.substring(body, a["at"] + 1, F.greatest(F.lit(0), s["s"] - a["at"])), F.repeat(F.lit(mark), s["e"] - F.greatest(s["s"], a["at"]))).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))),
    )
    text = F.when(F.size(every) > 0, covered).otherwise(F.col("row")[text_col])
    return found.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


