"""Secret scans with built-in expressions only.

Three base patterns give spans; a battery of randomness tests adds more. Runs of
20 or more characters of the base64 alphabets that hold letters and digits are
candidates. Each gets an encoding (hex, base32, base62, base64) from its
characters and three tests of the hypothesis that it was drawn at random from
that alphabet: chi-squared uniformity (Wilson-Hilferty), runs above and below the
middle (two-sided), and serial correlation (two-sided). The smallest p-value,
times three, is the candidate's. Over all candidates of the table a weighted
Benjamini-Hochberg procedure with weights in proportion to length rejects
structured strings at the false-discovery rate ``FDR``; what is not rejected
looks random and becomes a span of kind ``random``. Where base spans cover part of
a run, what is left of it on either side is a candidate if it is long enough itself.
P-values are rounded up to twentieths of a power of ten, so the global step needs
a count for each of at most 801 bins, not a sorted list.

Nulls: a null or empty text has no spans. Control characters 1 and 2 serve as
marks; where a text holds them, 3 stands in for them while matching, which no
pattern tells apart. Repeated rows are scanned each and their candidates count
each; equal p-values share a bin and are kept or rejected together. An empty table
gives an empty result. A very long text is scanned whole, in one row; a list of
matches is copied as it grows, so a text of very many matches takes time in
proportion to their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Fixed by the contract of op7. Java's case folding isn't used: classes name both cases.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
LEAST = 20
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"

KINDS = ("assign", "access", "hex", "random")
FDR = 0.05
BINS = 800

#: Alphabets in the order of their codes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _spans(clean: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start,end,token>> of the pattern's matches in column ``clean``, left to right.

    Matches are set between marks; after a split at the marks every second piece
    is a match, and the lengths of the pieces before it add up to its start.
    """
    marked = F.regexp_replace(clean, pattern, "\u0001$0\u0002")
    pieces = F.split(marked, "[\u0001\u0002]", -1)
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,token:string>>)")

    def step(acc, piece):
        size = F.length(piece)
        keep = acc["odd"] & ((F.length(F.regexp_extract(piece, pattern, group)) >= least) if group else F.lit(True))
        here = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + size).alias("end"), piece.alias("token")))
        return F.struct((acc["at"] + size).alias("at"), (~acc["odd"]).alias("odd"), F.when(keep, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.col(clean).rlike(pattern), folded).otherwise(none)


#: The published Chebyshev fit of log(erfc), right to 1.2e-7 of the value itself, however small that is.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, right in proportion also where it is very small. ``z`` is named often: give it a field."""
    t = 1.0 / (1.0 + F.abs(z) * (0.5 * 0.5**0.5))
    power = F.lit(ERFC[0])
    for c in ERFC[1:]:
        power = power * t + c
    far = 0.5 * t * F.exp(power - z * z / 2.0)
    return F.when(z >= 0, far).otherwise(1.0 - far)


def _encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(token.rlike("^[A-Z2-7]+=*$"), F.lit("base32"))
        .when(token.rlike("^[A-Za-z0-9]+$"), F.lit("base62"))
        .otherwise(F.lit("base64"))
    )


def _with(array: str, **fields):
    """The array of structs with fields added, each a function of the element. One step at a time keeps expressions small:
    a later step names what an earlier one computed instead of repeating it."""
    return lambda rows: rows.withColumn(array, F.transform(array, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), *[f(x).alias(k) for k, f in fields.items()])))


def battery(rows: DataFrame, array: str) -> DataFrame:
    """Turns the array's tokens (start, end, token) into p: the p-value of the hypothesis that the token is random."""
    same = lambda k: lambda x: x[k]
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    kept = {k: same(k) for k in ("size", "kinds")}
    steps = [
        _with(array, token=same("token"), encoding=lambda x: _encoding(x["token"])),
        _with(
            array, text=lambda x: F.translate(F.when(x["encoding"] == "hex", F.lower(x["token"])).otherwise(x["token"]), "-_=", "+/"),
            alphabet=lambda x: F.coalesce(*[F.when(x["encoding"] == k, F.lit(v)) for k, v in ALPHABETS.items()]),
        ),
        _with(array, text=same("text"), alphabet=same("alphabet"), letters=lambda x: F.split(x["text"], "")),
        _with(
            array, size=lambda x: F.size(x["letters"]).cast("double"), kinds=lambda x: F.length(x["alphabet"]).cast("double"),
            squares=lambda x: F.aggregate(F.array_distinct(x["letters"]), F.lit(0.0), lambda a, c: a + F.pow(F.length(x["text"]) - F.length(F.replace(x["text"], c, F.lit(""))), F.lit(2.0))),
            codes=lambda x: F.transform(x["letters"], lambda c: F.instr(x["alphabet"], c).cast("double")),
        ),
        _with(array, **kept, squares=same("squares"), codes=same("codes"), mean=lambda x: total(x["codes"]) / x["size"], high=lambda x: total(F.transform(x["codes"], lambda a: F.when(a > x["kinds"] / 2.0, 1.0).otherwise(0.0)))),
        _with(
            array, **kept, ratio=lambda x: (x["kinds"] / x["size"] * x["squares"] - x["size"]) / (x["kinds"] - 1.0), double=lambda x: 2.0 * x["high"] * (x["size"] - x["high"]),
            runs=lambda x: 1.0 + total(F.zip_with(F.slice(x["codes"], 1, F.size(x["codes"]) - 1), F.slice(x["codes"], 2, F.size(x["codes"]) - 1), lambda a, b: F.when((a > x["kinds"] / 2.0) != (b > x["kinds"] / 2.0), 1.0).otherwise(0.0))),
            serial=lambda x: total(F.zip_with(F.slice(x["codes"], 1, F.size(x["codes"]) - 1), F.slice(x["codes"], 2, F.size(x["codes"]) - 1), lambda a, b: (a - x["mean"]) * (b - x["mean"]))),
            variance=lambda x: F.greatest(total(F.transform(x["codes"], lambda a: (a - x["mean"]) * (a - x["mean"]))), F.lit(1e-9)),
        ),
        _with(
            array,
            chi=lambda x: (F.pow(F.greatest(x["ratio"], F.lit(0.0)), F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * (x["kinds"] - 1.0)))) / F.sqrt(2.0 / (9.0 * (x["kinds"] - 1.0))),
            run=lambda x: F.abs((x["runs"] - (x["double"] / x["size"] + 1.0)) / F.sqrt(F.greatest(x["double"] * (x["double"] - x["size"]) / (x["size"] * x["size"] * (x["size"] - 1.0)), F.lit(1e-9)))),
            lag=lambda x: F.abs((x["serial"] / x["variance"] + 1.0 / x["size"]) * F.sqrt(x["size"])),
        ),
        _with(array, p=lambda x: F.least(F.lit(1.0), 3.0 * F.least(_tail(x["chi"]), 2.0 * _tail(x["run"]), 2.0 * _tail(x["lag"])))),
    ]
    for step in steps:
        rows = step(rows)
    return rows


def _left(run: Column, covers: Column) -> Column:
    """The pieces of a run (start, end, token) that the covers, in order of start, leave."""

    def piece(a, b):
        b = F.greatest(a, b)
        return F.array(F.struct(a.alias("start"), b.alias("end"), F.substring(run["token"], a - run["start"] + 1, b - a).alias("token")))

    def step(acc, c):
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], F.least(c["start"], run["end"]))).alias("out"))

    none = F.expr("CAST(array() AS array<struct<start:int,end:int,token:string>>)")
    cut = F.aggregate(covers, F.struct(run["start"].alias("at"), none.alias("out")), step, lambda acc: F.concat(acc["out"], piece(acc["at"], run["end"])))
    return F.when(F.size(covers) == 0, F.array(run)).otherwise(cut)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, assign, access, hex (spans) and candidates with the bin of their p-value over length; one pass over the texts."""
    spare = F.translate(F.coalesce("text", F.lit("")), "\u0001\u0002", "\u0003\u0003")
    rows = docs.select("doc_id", spare.alias("clean"))
    rows = rows.select("doc_id", _spans("clean", ASSIGN, 2, 6).alias("assign"), _spans("clean", ACCESS).alias("access"), _spans("clean", HEX).alias("hex"), _spans("clean", CANDIDATE).alias("found"))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    base = F.concat("assign", "access", "hex")
    left = F.flatten(F.transform("found", lambda x: _left(x, F.array_sort(F.filter(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))))
    open_ = F.filter(left, lambda x: (x["end"] - x["start"] >= LEAST) & x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]"))
    rows = rows.select("doc_id", bare("assign").alias("assign"), bare("access").alias("access"), bare("hex").alias("hex"), open_.alias("found"))

    rows = battery(rows, "found")
    place = lambda x: F.floor(F.lit(20.0) * -F.log10(F.greatest(x["p"], F.lit(1e-30)) / (x["end"] - x["start"]))).cast("int")
    return _with("found", bin=lambda x: F.least(F.greatest(place(x), F.lit(0)), F.lit(BINS)))(rows)


def threshold(scanned: DataFrame, fdr: float = FDR) -> int:
    """The first bin that is rejected: weighted Benjamini-Hochberg on counts of at most 801 bins."""
    each = scanned.select(F.explode("found").alias("x"))
    bins = each.groupBy(F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("x.end") - F.col("x.start")).alias("size")).collect()
    whole = sum(r["size"] for r in bins)
    rejected, first = 0, BINS + 1
    for r in sorted(bins, key=lambda r: -r["bin"]):
        rejected += r["n"]
        if 10 ** (-r["bin"] / 20) <= rejected * fdr / whole:
            first = r["bin"]
    return first


def _listed(kinds: dict[str, Column]) -> Column:
    def tagged(i, kind):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))

    return F.array_sort(F.concat(*[F.transform(c, tagged(i, k)) for i, (k, c) in enumerate(kinds.items())]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, spans (array of start, rank, end, kind) with base (those of the base patterns)."""
    scanned = materialize(scan(docs), "secrets")
    first = threshold(scanned, fdr)
    base = {k: F.col(k) for k in KINDS[:3]}
    loose = F.filter("found", lambda x: x["bin"] < first)
    return scanned.select("doc_id", "assign", "access", "hex", _listed(base).alias("base"), _listed(base | {"random": loose}).alias("spans"))


def report(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """The digest columns of the contract of op7."""
    size = lambda c: F.size(c).cast("long")
    found = find(docs, fdr)
    return found.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, fdr: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; secrets in ``text`` replaced by ``mark``, n_chars following where there is one.

    Texts are scanned once: rows are written with their spans and candidates, and
    read back when the threshold is known. Nothing but its counts is shuffled.
    """
    names = docs.columns
    keyed = docs.select(F.struct(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("__row")).alias("doc_id"), docs["text"].alias("text"))
    scanned = materialize(scan(keyed), "scanned")
    first = threshold(scanned, fdr)
    loose = F.filter("found", lambda x: x["bin"] < first)
    spans = _listed({"assign": F.col("assign"), "access": F.col("access"), "hex": F.col("hex"), "random": loose})
    rows = scanned.select(F.col("doc_id.__row").alias("__row"), spans.alias("__spans"))
    at = {c: F.col(f"__row.c{i}") for i, c in enumerate(names)}

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        more = F.when(fresh, F.concat(acc["out"], F.substring(at["text"], acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(at["text"], acc["at"] + 1, F.length(at["text"]))))
    rows = rows.select("__row", F.when(F.size("__spans") > 0, clean).otherwise(at["text"]).alias("__text"), (F.size("__spans") > 0).alias("__hit"))
    own = lambda c: F.col("__text") if c == "text" else F.when(F.col("__hit"), F.length("__text").cast("long")).otherwise(at[c]) if c == "n_chars" else at[c]
    return rows.select(*[own(c).cast(docs.schema[c].dataType).alias(c) for c in names])
