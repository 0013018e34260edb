"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds of the base (email, ip, card, phone) stay whatever their context, which only sets their score.
Of the added kinds, account numbers (iban) must have their country's length and pass mod-97, and
ids of persons (national) must pass their own checksum; both stay unless words nearby speak against
them, as one number in 97, 23 or 11 passes by chance. Local phone numbers (tel), social
security numbers (ssn) and secrets need a word nearby that speaks for them; a word that the
reach of 40 characters cuts does not count. A long number that is
followed by more letters is read to its country's length, not to the end of the run.

Scale: one pass of Arrow batches over whole texts, no shuffle; every pattern is linear in the
text (runs are entered at their start only, and e-mail is searched from each ``@``).

Edge cases: a null or empty text has no spans; very long texts are scanned whole; repeated rows
are scanned one by one; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import refuse

KINDS = ("email", "ip", "card", "phone", "iban", "tel", "secret", "national", "ssn")
BASE_KINDS = KINDS[:4]
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}")
_TEL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[ ]?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
_NATIONAL = re.compile(r"(?<![A-Za-z0-9])(?:[XYZ]?[0-9]{7,8}-?[A-Z]|[1-9][0-9]{10}|[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")

#: Lengths of account numbers by country code.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}
#: The letter of a Spanish id by its number modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

#: Words that raise or lower the score of a proposal when near it.
NEAR = {
    "email": ({"mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt", "adresse"}, {"example", "sample", "beispiel", "ejemplo"}),
    "ip": ({"ip", "address", "host", "server", "adresse", "dirección", "login", "client", "ipv"}, {"version", "release", "section", "chapter", "versión", "kapitel"}),
    "card": ({"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta", "cvv", "expires"}, {"isbn", "order", "id", "serial", "tracking"}),
    "phone": ({"phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "telefon", "handy", "téléphone", "portable", "teléfono", "móvil"}, {"price", "preis", "prix", "precio"}),
    "iban": ({"iban", "account", "bank", "konto", "bic", "swift", "transfer", "compte", "cuenta", "banque", "banco"}, {"isbn", "serial", "model", "order", "part", "sku"}),
    "tel": ({"phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "telefon", "handy", "téléphone", "portable", "teléfono", "móvil"}, {"price", "isbn", "page", "order", "preis", "prix", "precio"}),
    "secret": ({"token", "secret", "key", "password", "api_key", "apikey", "passwd", "bearer", "credential", "credentials", "auth", "access_key", "private"}, {"sha1", "sha256", "sha512", "md5", "commit", "checksum", "hash", "digest"}),
    "national": ({"dni", "nie", "nif", "steuer-id", "steuernummer", "idnr", "nir", "insee", "identity", "passport", "ausweis", "documento"}, {"isbn", "serial", "order", "invoice", "tracking", "sku", "model", "part"}),
    "ssn": ({"ssn", "social", "security", "taxpayer", "itin"}, {"isbn", "order", "part", "tel", "phone"}),
}
#: Score before context: of the added kinds, those with a checksum start above the threshold, the others below.
START = {"email": 0.8, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.7, "tel": 0.35, "secret": 0.3, "national": 0.55, "ssn": 0.4}
THRESHOLD, BONUS, REACH = 0.5, 0.25, 40
_NEAR_WORD = re.compile(r"[^\W_]+(?:[-_][^\W_]+)*")
_JOINED, _CUT_HEAD, _CUT_TAIL = re.compile(r"[\w-]"), re.compile(r"\A[\w-]+"), re.compile(r"[\w-]+\Z")


def luhn(digits: str) -> bool:
    """Luhn checksum of ASCII digits."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 mod 97-10 over letters and digits, as for account numbers."""
    code = re.sub(r"\s", "", code).upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_end(code: str) -> int:
    """Length of the account number that a run of letters, digits and single separators begins with; 0 if none.

    A known country's number has that country's length; for others, ends are tried from the longest on.
    """
    at = [i + 1 for i, c in enumerate(code) if c.isalnum()]
    known = IBAN_LENGTH.get(code[:2])
    for n in [known] if known else range(min(len(at), 34), 14, -1):
        if n <= len(at) and (at[n - 1] == len(code) or known or not code[at[n - 1]].isalnum()) and mod97(code[: at[n - 1]].replace("-", "")):
            return at[n - 1]
    return 0


def national_id(code: str) -> bool:
    """Whether a Spanish, German or French id of a person has its check letter or digits."""
    code = re.sub("[ -]", "", code)
    if code[-1].isalpha():
        number = code[:-1].translate(str.maketrans("XYZ", "012"))
        return len(number) == 8 and DNI_LETTERS[int(number) % 23] == code[-1]
    if len(code) == 15:
        return 97 - int(code[:13]) % 97 == int(code[13:]) and 1 <= int(code[3:5]) <= 12
    rest = 10
    for d in code[:10]:
        rest = ((int(d) + rest) % 10 or 10) * 2 % 11
    digits = [code[:10].count(d) for d in set(code[:10])]
    return (11 - rest) % 10 == int(code[10]) and max(digits) in (2, 3) and len(digits) >= 8


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: the local part is the whole run before an ``@``."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()


def _more(text: str) -> Iterator[tuple[str, int, int]]:
    at = 0
    while m := _IBAN.search(text, at):
        end = m.start() + iban_end(m[0])
        after = text[end : end + 1]
        if end > m.start() and not (after.isascii() and after.isalnum()):
            yield "iban", m.start(), end
        at = max(end, m.start() + 1)
    for m in _TEL.finditer(text):
        yield "tel", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 5 and sum(c.isalpha() for c in m[0]) >= 5:
            yield "secret", m.start(), m.end()
    for m in _NATIONAL.finditer(text):
        if national_id(m[0]):
            yield "national", m.start(), m.end()
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def _around(text: str, start: int, end: int) -> str:
    """The text within REACH of a span on both sides, without words that the reach would cut."""
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    before, after = text[low:start], text[end:high]
    if low and _JOINED.match(text[low - 1]):
        before = _CUT_HEAD.sub("", before, count=1)
    if high < len(text) and _JOINED.match(text[high]):
        after = _CUT_TAIL.sub("", after, count=1)
    return f"{before} {after}".lower()


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = set(_NEAR_WORD.findall(_around(text, start, end)))
    more, less = NEAR[kind]
    return START[kind] + BONUS * bool(around & more) - BONUS * bool(around & less)


def spans_of(text: str | None) -> list[dict]:
    """Spans of one text by kind, then start; base kinds that pass their checks always stay."""
    if not text:
        return []
    found = [(k, s, e, max(THRESHOLD, _score(text, k, s, e))) for k, s, e in _base(text)]
    ends: list[int] = []  # of merged base spans
    starts: list[int] = []
    for s, e in sorted((s, e) for _, s, e, _ in found):
        if ends and s < ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(s)
            ends.append(e)
    for k, s, e in _more(text):
        at = bisect_right(ends, s)
        if (at == len(starts) or e <= starts[at]) and (score := _score(text, k, s, e)) >= THRESHOLD:
            found.append((k, s, e, score))
    found.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return [{"kind": k, "start": s, "end": e, "score": round(v, 3)} for k, s, e, v in found]


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """docs with ``out``: array of (kind, start, end, score), offsets in code points."""
    refuse(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(SPAN))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = pa.array([spans_of(x.as_py()) for x in texts], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """Replace each span by its kind in brackets; overlapping spans are cut to what is left."""
    order = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    body = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        part = F.concat(acc["done"], F.substr(body, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < acc["at"], F.struct(acc["done"].alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(F.struct(part.alias("done"), s["end"].alias("at")))

    cut = F.aggregate(order, start, step, lambda a: F.concat(a["done"], F.substr(body, a["at"].cast("int") + 1)))
    return docs.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(body))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts by base kind, the digest of base spans, all spans, and how many the method adds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).drop("text")
    spans = F.col("pii_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    added = F.size(F.filter(spans, lambda s: ~s["kind"].isin(*BASE_KINDS))).cast("long").alias("n_added")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), added)
