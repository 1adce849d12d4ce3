"""Personal data and secrets: candidates by pattern, decided by validators, replaced where they stand; licences by line.

Each detector takes the text that the ones before it left, so a span has one kind, that of the first detector which accepts it,
and a candidate that is rejected stays in the text for the later ones. A text is parted at a detector's candidates and put
together again with marks in place of those accepted: one pass, whatever their number. All repeats that could scan a long word again
and again are bounded, so time stays linear in the text. Built-in functions only, no shuffle.

Defined results: null texts are empty; repeated rows, null and equal ids are rows of their own; columns other than id and text are
left out; no rows give no rows. Patterns are plain ASCII and have no word boundaries: a candidate is a maximal run of its characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least bits a character of a secret, and least number of its digits.
SECRET_ENTROPY, SECRET_DIGITS = 3.0, 3

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
ADDRESS = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
CARD = r"[0-9](?:[ -]?[0-9]){12,40}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
SECRET = r"[A-Za-z0-9_+/=-]{20,}"
LICENCE = r"(?i)licen[sc]ed under|released under|spdx-license-identifier|copyright (?:\(c\)|©) ?[0-9]{4}"
#: Kinds of licence by what their line says, the first that fits.
LICENCES = [("noncommercial", r"(?i)by-nc|non-?commercial"), ("copyleft", r"(?i)gpl|general public|share-?alike|by-sa|mozilla"), ("permissive", r"(?i)mit|apache|bsd|isc|cc0|cc by")]


def characters(text: Column) -> Column:
    return F.split(text, "")


def good_email(m: Column) -> Column:
    return (F.char_length(m) <= 254) & ~F.contains(m, F.lit("..")) & ~F.rlike(m, F.lit(r"^\.|\.@|@-|-\.")) & F.rlike(m, F.lit(r"\.[A-Za-z]{2,}$"))


def good_address(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda o: (o.cast("int") <= 255) & (~F.startswith(o, F.lit("0")) | (o == "0")))


def luhn(digits: Column) -> Column:
    """Whether the digits' check digit fits: from the end, every second one doubled and cast out by nine."""
    def weigh(d, i):
        v = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.transform(characters(F.reverse(digits)), weigh), F.lit(0), lambda a, v: a + v) % 10 == 0


def good_card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    return F.char_length(digits).between(13, 19) & (F.size(F.array_distinct(characters(digits))) > 1) & luhn(digits)


def good_iban(m: Column) -> Column:
    """Whether the number, its first four characters put last and letters read as 10 to 35, leaves 1 modulo 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def take(a, c):
        v = F.ascii(c)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.char_length(plain).between(15, 34) & (F.aggregate(characters(turned), F.lit(0), take) == 1)


def entropy(m: Column) -> Column:
    """Bits a character."""
    n = F.char_length(m)
    share = lambda c: (n - F.char_length(F.replace(m, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(characters(m)), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def good_secret(m: Column) -> Column:
    digits = F.char_length(m) - F.char_length(F.regexp_replace(m, "[0-9]", ""))
    return (digits >= SECRET_DIGITS) & F.rlike(m, F.lit("[A-Za-z]")) & (entropy(m) >= SECRET_ENTROPY)


#: In order of precedence: (kind, pattern of candidates, validator).
DETECTORS: list[tuple[str, str, Callable[[Column], Column]]] = [
    ("email", EMAIL, good_email), ("address", ADDRESS, good_address), ("card", CARD, good_card), ("iban", IBAN, good_iban), ("secret", SECRET, good_secret),
]


def marks(found: str, mark: str, valid: Callable[[Column], Column]) -> Column:
    return F.transform(found, lambda m: F.when(valid(m), mark))


def any_line(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda x: F.rlike(x, F.lit(pattern)))


def redact(docs: DataFrame, detectors=None) -> DataFrame:
    """(doc_id, text) -> (doc_id, text, n_<kind> for each detector, redacted)."""
    detectors = DETECTORS if detectors is None else detectors
    now = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("redacted", F.col("text"))
    kept = ["doc_id", "text"]
    for kind, pattern, valid in detectors:
        now = now.select(*kept, "redacted", F.regexp_extract_all("redacted", F.lit(pattern), F.lit(0)).alias("found"))
        now = now.select(*kept, "redacted", "found", marks("found", f"[{kind.upper()}]", valid).alias("marks"))
        hits = F.size(F.filter("marks", lambda m: m.isNotNull()))
        told = F.zip_with("found", "marks", lambda m, k: F.coalesce(k, m))
        whole = F.array_join(F.zip_with(F.split("redacted", pattern, -1), told, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
        now = now.select(*kept, hits.cast("long").alias(f"n_{kind}"), F.when(hits > 0, whole).otherwise(F.col("redacted")).alias("redacted"))
        kept.append(f"n_{kind}")
    return now


def licensed(text: Column) -> tuple[Column, Column]:
    """How many lines state a licence, and the kind of the strictest; null if none does."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(LICENCE)))
    kind = F.when(F.size(lines) > 0, "other")
    for name, pattern in reversed(LICENCES):
        kind = F.when(any_line(lines, pattern), name).otherwise(kind)
    return F.size(lines).cast("long"), kind


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_email, n_address, n_card, n_iban, n_secret, n_licence, licence, redacted)."""
    n, kind = licensed(F.col("text"))
    return redact(docs).select("doc_id", *[f"n_{k}" for k, _, _ in DETECTORS], n.alias("n_licence"), kind.alias("licence"), "redacted")
