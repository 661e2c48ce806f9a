"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Built-in SQL functions only. Matches are marked with two control characters (which no pattern can match) and
the marked text is split at them, so that positions come from the lengths of the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
#: The same languages as the plain patterns, written so that no attempt goes back over a run it has read:
#: possessive loops, and a start only at the head of a run or where the match before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Length of an IBAN by country, from the registry.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(" ".join(IBAN.values()).split())
#: A span ends with its country's length, whatever capitals and digits follow; that of a country without one is as
#: long as can be, up to the next IBAN of a known one.
PATTERNS["iban"] = (
    "(?<![A-Za-z0-9])(?:" + "".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}|" for n, c in IBAN.items())
    + rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{_KNOWN})[0-9]{{2}}) ?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
)
#: Lower-case words that raise the score of a span when one stands in the 40 characters before or after it.
CONTEXT = {
    "email": ["mail", "contact", "write"],
    "ip": ["ip", "address", "host", "server"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "tel", "call", "mobile", "fax"],
    "iban": ["iban", "bank", "account", "konto"],
    "ssn": ["ssn", "social security", "tax id"],
}
#: Score before context; a checksum counts 0.3, a context word 0.3, and spans beyond the base kinds need 0.5.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.3}
CHECKED = {"card", "iban"}
LEAST = 0.5
#: Items that a fold which appends takes at a time, so that its work does not grow with their square.
CHUNK = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN, blanks removed, leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        v = F.ascii(c)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) > 3, F.lit(False)).otherwise(F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def _guard(kind: str, t: Column) -> Column:
    """True for every text in which the pattern could match; cheap."""
    return {
        "email": F.contains(t, F.lit("@")),
        "ip": t.rlike(r"[0-9]\.[0-9]"),
        "card": t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
        "phone": F.contains(t, F.lit("+")),
        "iban": t.rlike(r"[A-Z]{2}[0-9]{2}"),
        "ssn": t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    }[kind]


def _fold(items: Column, empty: Column, outs: str, step) -> Column:
    """Outs (of SQL type ``outs``) of a fold over ``items`` whose state is (pos, out), by CHUNK items: a state's ``out``
    is copied at every item, so it starts anew with each chunk."""
    last = F.greatest(F.floor((F.size(items) - 1) / CHUNK).cast("int"), F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))

    def one(a: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(a["pos"].alias("pos"), empty.alias("out")), step)
        # bound to a name within an array, so that it is worked out once
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["pos"].alias("pos"), F.concat(a["outs"], F.array(x["out"])).alias("outs"))), F.lit(0))

    zero = F.struct(F.lit(0).alias("pos"), F.expr(f"cast(array() as array<{outs}>)").alias("outs"))
    return F.aggregate(chunks, zero, one, lambda a: a["outs"])


def found(kind: str, t: Column) -> Column:
    """Array of (start, kind index, end, score) of the spans that hold; positions in code points, end exclusive."""
    k = KINDS.index(kind)
    parts = F.split(F.regexp_replace(t, f"({PATTERNS[kind]})", "\x01$1\x02"), "\x01")
    span_type = "array<struct<start:int,kind:int,end:int,score:double>>"
    empty = F.expr(f"cast(array() as {span_type})")
    words = "|".join(CONTEXT[kind])

    def plain(x: Column) -> Column:
        return F.translate(x, "\x02", "")

    def read(all_parts: Column) -> Column:
        """Of each part its length, its span if one holds, and the score by the 40 characters before and after it.

        As no span has less than five characters, eight more parts on either side hold as many.
        """

        def one(p: Column, i: Column) -> Column:
            hit = F.contains(p, F.lit("\x02"))
            m = F.substring_index(p, "\x02", 1)
            later = F.transform(F.slice(all_parts, i + 2, 8), lambda q: F.left(plain(F.left(q, F.lit(41))), F.lit(40)))
            after = F.left(F.concat(F.left(F.substring_index(p, "\x02", -1), F.lit(40)), F.array_join(later, "")), F.lit(40))
            earlier = F.transform(F.slice(all_parts, F.greatest(i - 7, F.lit(1)), F.least(i, F.lit(8))), lambda q: F.right(plain(F.right(q, F.lit(41))), F.lit(40)))
            before = F.right(F.array_join(earlier, ""), F.lit(40))
            near = F.lower(F.concat_ws("\x02", before, after)).rlike(rf"(?<![a-z])(?:{words})")
            score = F.least(F.lit(PRIOR[kind] + (0.3 if kind in CHECKED else 0.0)) + F.when(near, 0.3).otherwise(0.0), F.lit(1.0))
            told = F.when(hit & _holds(kind, m), score)
            told = told if kind in BASE else F.when(told >= LEAST, told)
            return F.struct((F.length(p) - F.when(hit, 1).otherwise(0)).alias("length"), F.length(m).alias("size"), told.alias("score"))

        return F.transform(all_parts, one)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"]
        span = F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + x["size"]).alias("end"), x["score"].alias("score"))
        return F.struct((start + x["length"]).alias("pos"), F.when(x["score"].isNotNull(), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    # bound to names within arrays, so that the parts are made once
    spans = F.get(F.transform(F.array(parts), lambda p: F.get(F.transform(F.array(read(p)), lambda r: F.flatten(_fold(r, empty, span_type, step))), F.lit(0))), F.lit(0))
    return F.when(_guard(kind, t), spans).otherwise(empty)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id and ``found``, its spans (start, kind, end, score) by start, then kind as listed.

    Null text counts as empty; repeated rows give repeated rows; an empty table gives an empty result; of the
    further columns only those in ``keep`` stay.
    """
    clean = F.translate(text_of(text_col), "\x01\x02", "\x03\x03")
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, clean.alias("_t"))
    spans = base.select("doc_id", *keep, *[found(k, F.col("_t")).alias(f"_{k}") for k in KINDS])
    return spans.select("doc_id", *keep, F.array_sort(F.concat(*[f"_{k}" for k in KINDS])).alias("found"))


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digest(spans: DataFrame) -> DataFrame:
    """Counts and digests of ``pii_spans``."""
    f = F.col("found")

    def count(k: int) -> Column:
        return F.size(F.filter(f, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    base = F.filter(f, lambda s: s["kind"] < len(BASE))
    return spans.select(
        "doc_id", *counts[:4], F.sha2(_line(base), 256).alias("base_sha256"), _line(f).alias("spans"), *counts[4:],
        F.transform(f, lambda s: F.round(s["score"], 2)).alias("scores"),
    )


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle brackets; null text stays null.

    Overlapping spans are masked from the first start to the last end under the first kind.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    t = F.col(text_col)
    clean = F.translate(text_of(text_col), "\x01\x02", "\x03\x03")

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["pos"]
        between = F.substring(t, acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(new, F.concat(acc["out"], between, F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"),
        )

    def replaced(spans: Column) -> Column:
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.when(F.size(spans) > 0, F.concat(F.array_join(_fold(spans, F.lit(""), "string", step), ""), F.substring(t, last + 1, F.length(t)))).otherwise(t)

    spans = F.array_sort(F.concat(*[found(k, clean) for k in KINDS]))
    return docs.withColumn(text_col, F.get(F.transform(F.array(spans), replaced), F.lit(0)))
