"""Personal data by candidate gradient boosting (operator 4), with DataFrame functions only.

High-recall generators propose spans by regular expressions. The base kinds keep every span that passes its check.
Further generators (phones without a plus sign, spelled-out addresses, dotted card numbers, defanged ip addresses) propose
spans that may overlap others; boosted trees score them by format and context, and a span is added where its score
reaches its kind's calibrated threshold and it overlaps no span taken before.

The trees learn from planted truth: values of known kind and decoys of the same formats (order numbers, versions, serials,
prose), with and without words that announce them, are set between scraps of a bounded number of documents; all
generators' candidates there are labelled by what was planted, and thresholds are calibrated on texts held out. The trees
are written out as an expression, so that the main path is one scan without a shuffle. Positions come from running sums
by doubling steps, so that a text with many spans costs n log n.

Positions count code points. Edge cases: a null text is empty (redact leaves it null); null ids and repeated rows are rows
of their own; an empty table gives no rows; extra columns, whatever their names, are kept by redact and ignored by find.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents between whose scraps values are planted, at most: those with the smallest hashes.
SAMPLE = 400
#: Code points of a document on each side of a planted value.
SCRAP = 64
#: Share of right spans that a threshold must reach on the calibration part.
PRECISION = 0.95
KINDS = ("email", "ip", "card", "phone")
#: Base patterns in linear-time form: possessive, and started only where a leftmost match can start.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: kind, pattern, and a pattern without which the first can't match.
MORE = (
    ("phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "[0-9]{4}"),
    ("email", rf"(?<!{LOCAL}){LOCAL}++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{{2,}}", "dot"),
    ("card", r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])", r"[0-9]\.[0-9]"),
    ("ip", r"(?<![0-9\]])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])", r"\[\.\]"),
)
CUES = r"(?i)(mail|e-mail|contact|tel|phone|call|mobile|fax|card|visa|ip|host|server|address)\W*$"
OTHER_CUES = r"(?i)(order|invoice|ref|serial|version|build|part|isbn|total|section)\W*$"
ENDINGS = r"(?i)(com|org|net|edu|info|io|de|fr|es)$"
GUARDS = {"email": "@", "phone": r"\+"}
GENERATORS = [(f"b{k}", kind, BASE[kind], GUARDS.get(kind, "[0-9]")) for k, kind in enumerate(KINDS)] + [(f"m{k}", *more) for k, more in enumerate(MORE)]
SPAN = "array<struct<kind:string,start:int,end:int>>"
CANDIDATE = "array<struct<kind:string,start:int,end:int,s:string,before:string,after:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn_sum(back: Column, doubled: int) -> Column:
    """Check sum of reversed digits; those at positions of this parity (from 1) count twice."""

    def add(total, i):
        v = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == doubled, 2).otherwise(1)
        return total + v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add)


def _luhn(s: Column) -> Column:
    """Whether 13 to 19 digits pass the check sum."""
    back = F.reverse(_digits(s))
    return F.when(F.length(back).between(13, 19), _luhn_sum(back, 0) % 10 == 0).otherwise(False)


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(s)
    return F.length(_digits(s)).between(9, 15)


def running(values: str, size: str, step: str) -> str:
    """SQL of a running fold of an array by doubling: step combines x with y, the element 2^k places before (null if none)."""
    return f"aggregate(sequence(0, greatest(cast(ceil(log2({size})) as int) - 1, 0)), {values}, (a, k) -> transform(a, (x, i) -> {step.replace('y', 'get(a, i - cast(pow(2, k) as int))')}))"


def _spans(kind: str, n: str) -> Column:
    """Structs of each match: start, end, its text and its surroundings, from the matches and the texts between them."""
    m, g = f"__f{n}", f"__g{n}"
    ends = running(f"zip_with({m}, slice({g}, 1, size({m})), (m, g) -> length(m) + length(g))", f"size({m})", "x + coalesce(y, 0)")
    zipped = f"arrays_zip({m}, {ends}, slice({g}, 1, size({m})), slice({g}, 2, size({m})))"
    named = f"cast({zipped} as array<struct<m:string,e:int,b:string,a:string>>)"
    return F.expr(f"transform({named}, z -> named_struct('kind', '{kind}', 'start', z.e - length(z.m), 'end', z.e, 's', z.m, 'before', right(z.b, 24), 'after', left(z.a, 8)))")


def candidates(docs: DataFrame) -> DataFrame:
    """docs (kept columns and text) with an array of candidate structs for each generator: b0 to b3 (base kinds), m0 and on."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    with_found = docs.select(*kept, *(F.when(text.rlike(guard), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"__f{n}") for n, _, p, guard in GENERATORS))
    names = [f"__f{n}" for n, *_ in GENERATORS]
    with_gaps = with_found.select(*kept, *names, *(F.when(F.size(F.coalesce(f"__f{n}", F.expr("array()"))) > 0, F.split(text, p, -1)).alias(f"__g{n}") for n, _, p, _ in GENERATORS))
    return with_gaps.select(*kept, *(F.when(F.col(f"__g{n}").isNotNull(), _spans(kind, n)).otherwise(F.expr(f"cast(array() as {CANDIDATE})")).alias(n) for n, kind, *_ in GENERATORS))


def features(c: Column) -> Column:
    """Format and context of a candidate."""
    s, before, after = c["s"], c["before"], c["after"]

    def size(pattern):
        return F.length(F.regexp_replace(s, pattern, ""))

    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    parts = F.split(F.regexp_replace(s, r"[\[\]]", ""), r"\.")
    return F.array(
        *(yes(c["kind"] == k) for k in KINDS), size("[^0-9]").cast("double"), size("[^A-Za-z]").cast("double"), size("[A-Za-z0-9]").cast("double"), F.length(s).cast("double"),
        (F.size(F.split(s, "[^0-9]+")) - 1).cast("double"), F.size(parts).cast("double"), F.array_max(F.transform(parts, lambda p: F.coalesce(F.right(p, F.lit(9)).try_cast("double"), F.lit(0.0)))),
        yes(s.startswith("+")), yes(F.contains(s, F.lit("@"))), yes(_luhn(s)), yes(s.rlike(ENDINGS)), yes(s.rlike(r"[\[(]")),
        yes(before.rlike(r"[A-Za-z0-9]$")), yes(after.rlike("^[A-Za-z0-9]")), yes(before.rlike(CUES)), yes(before.rlike(OTHER_CUES)),
    )


# ---------------------------------------------------------------- planted truth


def _number(n: int, k: int) -> str:
    """SQL of n pseudo-random digits of row r."""
    return f"lpad(cast(pmod(xxhash64(r, {k}), {10**n}) as string), {n}, '0')"


def _part(below: int, k: int) -> str:
    return f"cast(pmod(xxhash64(r, {k}), {below}) as string)"


def _pick(words: tuple[str, ...], k: int) -> str:
    return f"element_at(array({', '.join(map(repr, words))}), cast(pmod(xxhash64(r, {k}), {len(words)}) as int) + 1)"


SYLLABLES = ("mar", "lo", "ti", "ren", "sa", "kov", "bel", "dun", "in", "est", "ha", "or")


def _word(k: int) -> str:
    return f"concat({_pick(SYLLABLES, k)}, {_pick(SYLLABLES, k + 100)}, {_pick(SYLLABLES, k + 200)})"


def _forms() -> list[tuple[str, bool, str]]:
    """kind, whether it is personal data, SQL of a value (of digits of `card` for card numbers, whose check digit is right)."""
    first, second, site, end = _word(1), _word(2), _word(3), _pick(("com", "org", "net", "de", "fr", "es"), 4)
    out = [("email", True, f"concat({a})") for a in (f"{first}, '.', {_number(2, 5)}, '@', {site}, '.', {end}", f"{first}, ' [at] ', {site}, ' [dot] ', {end}", f"{first}, '(at)', {site}, '(dot)', {end}", f"{first}, ' at ', {site}, ' dot ', {end}", f"{first}, '.', {second}, ' at ', {site}, ' dot ', {end}")]
    out += [("email", False, f"concat({first}, ' at ', {second}, ' dot ', {site})")] * 3 + [("email", False, f"concat({first}, '(at)', {second}, '(dot)', {site})")]
    for real in (True, False):
        a, b, c = _number(3, 6), _number(3, 7), _number(4, 8)
        out += [("phone", real, f"concat({x})") for x in (f"{a}, '-', {b}, '-', {c}", f"{a}, '.', {b}, '.', {c}", f"{a}, ' ', {b}, ' ', {c}")]
        digits = "card" if real else _number(16, 9)
        four = [f"substring({digits}, {k}, 4)" for k in (1, 5, 9, 13)]
        out += [("card", real, f"concat_ws('{mark}', {', '.join(four)})") for mark in (".", ".", " ", "-")]
        octets = [_part(256 if real else 1000, k) for k in (10, 11, 12, 13)]
        out += [("ip", real, f"concat_ws('{mark}', {', '.join(octets)})") for mark in ("[.]", "[.]", ".")]
    out += [("phone", True, f"concat({x})") for x in (f"'(', {_number(3, 6)}, ') ', {_number(3, 7)}, '-', {_number(4, 8)}", f"'+1 (', {_number(3, 6)}, ') ', {_number(3, 7)}, '-', {_number(4, 8)}")]
    return out


ANNOUNCE = {"email": ("mail ", "contact: ", "e-mail: "), "phone": ("tel ", "phone: ", "call ", "mobile "), "card": ("card ", "visa: "), "ip": ("ip ", "host ", "server: ")}
OTHERWISE = ("order ", "invoice ", "ref ", "serial: ", "version ", "build ", "part ", "isbn ", "total ", "section ")


def planted(docs: DataFrame, sample: int = SAMPLE, salt: int = 0) -> DataFrame:
    """r, text, kind, start, end, personal: one value of each form between the scraps of each sampled document.

    The value is announced in seven cases of ten (decoys by words of another sort, in one of 35 by the same), else not.
    """
    texts = docs.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.right(F.coalesce("text", F.lit("")), F.lit(SCRAP)).alias("left"), F.left(F.coalesce("text", F.lit("")), F.lit(SCRAP)).alias("right"))
    drawn = texts.orderBy("h", "t", "left", "right").limit(sample).select(F.xxhash64("h", "t", F.lit(salt)).alias("doc"), "left", "right")
    number = drawn.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(_forms()) - 1))).alias("form")).withColumn("r", F.xxhash64("doc", "form"))
    payload = F.expr(_number(15, 14))
    number = number.withColumn("payload", payload).withColumn("card", F.concat("payload", ((10 - _luhn_sum(F.reverse("payload"), 1) % 10) % 10).cast("string")))
    value = kind = personal = cue = None
    for k, (what, real, form) in enumerate(_forms()):
        at = F.col("form") == k
        own, other = _pick(ANNOUNCE[what], 15), _pick(OTHERWISE, 16)
        said = F.expr(f"CASE WHEN pmod(xxhash64(r, 17), 10) >= 7 THEN '' WHEN {'true' if real else 'pmod(xxhash64(r, 18), 35) = 0'} THEN {own} ELSE {other} END")
        value, kind = (F.when(at, v) if had is None else had.when(at, v) for had, v in ((value, F.expr(form)), (kind, F.lit(what))))
        personal, cue = (F.when(at, v) if had is None else had.when(at, v) for had, v in ((personal, F.lit(real)), (cue, said)))
    made = number.select("r", F.concat("left", F.lit(" "), cue).alias("before"), value.alias("value"), F.col("right").alias("after"), kind.alias("kind"), personal.alias("personal"))
    start = F.length("before")
    return made.select("r", F.concat("before", "value", F.lit(" "), "after").alias("text"), "kind", start.alias("start"), (start + F.length("value")).alias("end"), "personal")


def labelled(examples: DataFrame) -> DataFrame:
    """r, kind, generator, label, x: all generators' candidates that lie on planted values; right ones cover nine tenths of personal data of their kind."""
    found = candidates(examples.select("r", "text", F.col("kind").alias("truth"), F.col("start").alias("from"), F.col("end").alias("to"), "personal"))
    each = F.concat(*(F.transform(n, (lambda n: lambda c: F.struct(F.lit(n).alias("generator"), c.alias("c")))(n)) for n, *_ in GENERATORS))
    c = F.col("g.c")
    common = F.least(c["end"], F.col("to")) - F.greatest(c["start"], F.col("from"))
    label = F.when(F.col("personal") & (c["kind"] == F.col("truth")) & (10 * common >= 9 * (F.col("to") - F.col("from"))), 1.0).otherwise(0.0)
    rows = found.select("r", "truth", "from", "to", "personal", F.explode(each).alias("g")).where(common > 0)
    return rows.select("r", c["kind"].alias("kind"), F.col("g.generator").alias("generator"), label.alias("label"), features(c).alias("x"))


def _tree(node, x: str) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"(CASE WHEN {x}[{split.featureIndex()}] <= {split.threshold()!r}D THEN {_tree(node.leftChild(), x)} ELSE {_tree(node.rightChild(), x)} END)"


def learn(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> tuple[str, dict[str, float]] | None:
    """The trees as an expression over the features x, and each kind's threshold; None without documents."""
    examples = labelled(planted(docs, sample)).withColumn("features", array_to_vector("x")).cache()  # bounded by sample and the forms
    try:
        train = examples.where("abs(r % 5) <> 0")
        if train.select("label").distinct().count() < 2:
            return None
        model = GBTClassifier(maxIter=12, maxDepth=4, seed=11, maxMemoryInMB=64).fit(train)
        margin = " + ".join(f"{w!r}D * {_tree(t._java_obj.rootNode(), 'x')}" for w, t in zip(model.treeWeights, model.trees, strict=True))
        score = f"1 / (1 + exp(-2 * ({margin})))"
        held = examples.where("abs(r % 5) = 0 and generator like 'm%'").selectExpr("kind", "label", f"round({score}, 3) p").groupBy("kind", "p").agg(F.sum("label").alias("right"), F.count("*").alias("n"))
        by: dict[str, list] = {}
        for r in held.collect():  # at most 1,001 rows for each kind
            by.setdefault(r.kind, []).append((r.p, r.right, r.n))
    finally:
        examples.unpersist()
    thresholds = {}
    for kind, points in by.items():
        right = n = 0
        for p, good, each in sorted(points, reverse=True):
            right, n = right + good, n + each
            if right >= precision * n:
                thresholds[kind] = p
    return score, thresholds


# ---------------------------------------------------------------- spans


def with_spans(docs: DataFrame, model: tuple[str, dict[str, float]] | None) -> DataFrame:
    """docs (row, text) with their counts n_<kind> and arrays of structs base and every (kind, start, end), by kind as listed, then start."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    slim = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    found = candidates(docs)
    base = {kind: F.transform(F.filter(f"b{k}", (lambda own: lambda c: _valid(own, c["s"]))(kind)), slim) for k, kind in enumerate(KINDS)}
    found = found.select(*kept, *(v.alias(f"v_{k}") for k, v in base.items()), *(f"m{k}" for k in range(len(MORE)))).withColumn("base", F.concat(*(F.col(f"v_{k}") for k in KINDS)))
    taken, added = F.col("base"), {k: [] for k in KINDS}
    for n, (kind, *_) in enumerate(MORE):
        if not model or kind not in model[1]:
            continue
        scored = F.transform(f"m{n}", lambda c: F.struct(slim(c).alias("span"), features(c).alias("x")))
        found = found.withColumn(f"x{n}", scored)
        passing = F.expr(f"transform(filter(x{n}, c -> {model[0].replace('x[', 'c.x[')} >= {model[1][kind]!r}D), c -> c.span)")
        found = found.withColumn(f"p{n}", F.when(F.size(f"x{n}") > 0, passing).otherwise(F.expr(f"cast(array() as {SPAN})")))
        found = _apart(found, f"p{n}", taken, f"a{n}")
        added[kind].append(F.col(f"a{n}"))
        taken = F.concat(taken, F.col(f"a{n}"))
    every = F.concat(*(F.array_sort(F.concat(F.col(f"v_{k}"), *added[k])) for k in KINDS))
    return found.select(*kept, *(F.size(f"v_{k}").cast("long").alias(f"n_{k}") for k in KINDS), "base", every.alias("every"))


def _apart(found: DataFrame, spans: str, taken: Column, name: str) -> DataFrame:
    """With the column name: those spans that overlap none taken. In the order of starts, no taken span before ends later, none after starts earlier."""
    owned = lambda own: lambda c: F.struct(c["start"], F.lit(own).alias("own"), c["end"], c["kind"])
    both = F.when(F.size(spans) > 0, F.array_sort(F.concat(F.transform(taken, owned(0)), F.transform(spans, owned(1)))))
    found = found.withColumn(f"o{name}", both)
    ends = running(f"transform(o{name}, c -> if(c.own = 0, c.end, 0))", f"size(o{name})", "greatest(x, y)")
    starts = running(f"reverse(transform(o{name}, c -> if(c.own = 0, c.start, 2147483647)))", f"size(o{name})", "least(x, y)")
    zipped = f"cast(arrays_zip(o{name}, {ends}, reverse({starts})) as array<struct<c:struct<start:int,own:int,end:int,kind:string>,e:int,s:int>>)"
    free = F.expr(f"transform(filter({zipped}, z -> z.c.own = 1 and z.e <= z.c.start and z.s >= z.c.end), z -> named_struct('kind', z.c.kind, 'start', z.c.start, 'end', z.c.end))")
    return found.withColumn(name, F.when(F.col(f"o{name}").isNotNull(), free).otherwise(F.expr(f"cast(array() as {SPAN})")))


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    docs = docs.select("doc_id", "text")
    return with_spans(docs, learn(docs)).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_written("base"), 256).alias("base_sha256"), _written("every").alias("spans"))


#: Spans whose surroundings are cut from the text at once; within them each span is cut from that section.
SECTION = 256


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    model = learn(docs.select("doc_id", "text"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    marked = with_spans(rows, model).select("row", "text", F.array_sort(F.transform("every", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))).alias("s"))
    some = F.size("s") > 0
    marked = marked.withColumn("e", F.when(some, F.expr(running("transform(s, c -> c.end)", "size(s)", "greatest(x, y)"))))
    heads = "filter(cast(arrays_zip(s, slice(concat(array(0), e), 1, size(s))) as array<struct<c:struct<start:int,end:int,kind:string>,b:int>>), z -> z.c.start >= z.b)"
    marked = marked.withColumn("h", F.when(some, F.expr(heads)))
    groups = f"transform(sequence(0, cast((size(h) - 1) / {SECTION} as int)), k -> slice(h, k * {SECTION} + 1, {SECTION}))"
    cut = f"transform({groups}, g -> named_struct('g', g, 'at', g[0].b, 't', substring(text, g[0].b + 1, element_at(g, -1).c.start - g[0].b)))"
    pieces = f"transform({cut}, q -> array_join(transform(q.g, z -> concat(substring(q.t, z.b - q.at + 1, z.c.start - z.b), '[', upper(z.c.kind), ']')), ''))"
    whole = F.expr(f"concat(array_join({pieces}, ''), substring(text, element_at(e, -1) + 1, length(text)))")
    text = F.when(some, whole).otherwise(F.col("text"))
    return marked.select(*(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
