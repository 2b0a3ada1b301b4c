"""Text recognisers as Column builders: personal data, secrets, hidden text, red flags."""

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.functions.scalars import fraction_paise, let, ordered_case, plain_number, strip

# ---------------------------------------------------------------- personal data
# fixed values: recognisers by kind, in Java syntax ((?U) makes \w \d \s Unicode)
PII_PATTERNS = {
    "email": r"(?U)(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"(?U)(?<!\d)(?:\+91[\s-]?|91[\s-]?|0)?[6-9]\d{9}(?!\d)",
    "pan": r"(?U)(?<![A-Z0-9])[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z](?![A-Z0-9])",
    "aadhaar": r"(?U)(?<!\d)[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}(?!\d)",
}
PII_TAGS = {
    "email": "PII_EMAIL",
    "phone": "PII_PHONE",
    "pan": "PII_PAN",
    "aadhaar": "PII_AADHAAR",
}
# fixed values: field names whose values are personal data whatever they look like
FIELD_TAGS = {
    "email": "PII_EMAIL",
    "phone": "PII_PHONE",
    "mobile": "PII_PHONE",
    "pan": "PII_PAN",
    "aadhaar": "PII_AADHAAR",
    "name": "PII",
    "address": "PII",
    "dob": "PII",
}


def _dihedral_product(a: int, b: int) -> int:
    """Product in the dihedral group of order ten (rotations 0-4, reflections 5-9)."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _position_permutations() -> list[list[int]]:
    """The eight powers of the Verhoeff position permutation."""
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([base[d] for d in rows[-1]])
    return rows


def verhoeff_valid(number: str | Column) -> Column:
    """Checksum over ASCII digits, check digit last; anything else is False."""
    n = F.col(number) if isinstance(number, str) else number
    product = F.array(*[F.lit(_dihedral_product(a, b)) for a in range(10) for b in range(10)])
    permuted = F.array(*[F.lit(v) for row in _position_permutations() for v in row])
    digits = F.transform(
        F.split(F.reverse(n), ""),
        lambda ch, i: F.get(permuted, (i % 8) * 10 + ch.try_cast("int")),
    )
    check = F.aggregate(digits, F.lit(0), lambda acc, d: F.get(product, acc * 10 + d))
    return F.coalesce(F.regexp_like(n, F.lit(r"\A[0-9]+\z")) & (check == 0), F.lit(False))


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def pii_values(text: str | Column, kind: str) -> Column:
    """All values of one kind in the text; Aadhaar numbers must pass their checksum."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(t, F.lit(PII_PATTERNS[kind]), 0)
    if kind == "aadhaar":
        return F.filter(found, lambda v: verhoeff_valid(_only_digits(v)))
    return found


def has_pii(text: str | Column, kind: str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    if kind == "aadhaar":
        return F.size(pii_values(t, kind)) > 0
    return F.regexp_like(t, F.lit(PII_PATTERNS[kind]))


def pii_spans(text: str | Column) -> Column:
    """Array of (kind, start, end), ordered by position; offsets count characters from 0.

    Each kind cuts the text at its matches: the pieces between give the offsets, so all matches
    come from one split and one find-all per kind, inside the JVM.
    """
    t = F.col(text) if isinstance(text, str) else text
    spans = [_spans_of(t, kind, pattern) for kind, pattern in PII_PATTERNS.items()]
    return F.array_sort(F.concat(*spans))


def _spans_of(text: Column, kind: str, pattern: str) -> Column:
    cut = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), 0).alias("values"),
        F.split(text, pattern).alias("pieces"),
    )
    start = "struct<at:int,spans:array<struct<start:int,end:int,kind:string>>>"

    def place(c: Column) -> Column:
        """Walk the matches once, adding the piece before each and the match itself."""
        numbered = F.transform(
            c["values"],
            lambda v, i: F.struct(F.length(F.get(c["pieces"], i)).alias("gap"), v.alias("value")),
        )

        def step(acc: Column, m: Column) -> Column:
            begin = acc["at"] + m["gap"]
            end = begin + F.length(m["value"])
            span = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
            if kind == "aadhaar":
                good = verhoeff_valid(_only_digits(m["value"]))
                span = F.when(good, span).otherwise(F.slice(span, 1, 0))
            return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans")).cast(start)

        nothing = F.array().cast("array<struct<start:int,end:int,kind:string>>")
        zero = F.struct(F.lit(0).alias("at"), nothing.alias("spans")).cast(start)
        return F.aggregate(numbered, zero, step, lambda acc: acc["spans"])

    return let(cut, place)


def pii_tags(text: str | Column) -> Column:
    """Sorted tags of a text, closed: a specific tag brings the general one."""
    specific = F.array_compact(
        F.array(*[F.when(has_pii(text, kind), F.lit(tag)) for kind, tag in PII_TAGS.items()])
    )
    return close_tags(specific)


def close_tags(tags: Column) -> Column:
    """Add the general personal-data tag wherever a specific one is present."""
    closed = F.when(
        F.exists(tags, lambda t: F.startswith(t, F.lit("PII"))),
        F.array_union(tags, F.array(F.lit("PII"))),
    ).otherwise(tags)
    return F.array_sort(F.array_distinct(closed))


def field_tag(name: str | Column) -> Column:
    """Tag of a field name (letters only, lower case), NULL when it says nothing."""
    n = F.col(name) if isinstance(name, str) else name
    table = F.create_map(*[F.lit(x) for pair in FIELD_TAGS.items() for x in pair])
    return F.try_element_at(table, F.regexp_replace(F.lower(n), "[^a-z]", ""))


# ---------------------------------------------------------------- secrets
_BEFORE = r"(?<![A-Za-z0-9])"
_AFTER = r"(?![A-Za-z0-9])"
SESSION_COOKIE = "gateway_session"


def secret_patterns(session_cookie: str = SESSION_COOKIE) -> tuple[tuple[str, str], ...]:
    """Ordered (kind, pattern) backstop; the order decides which kind a span is scrubbed as."""
    # fixed values, in Java syntax
    return (
        ("bearer", r"(?iU)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}"),
        ("api_key", r"(?<![A-Za-z0-9])(?:sk|pk|rk)-[A-Za-z0-9_-]{12,}"),
        ("api_key", _BEFORE + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _AFTER),
        ("api_key", _BEFORE + r"gh[pousr]_[A-Za-z0-9]{20,}"),
        (
            "api_key",
            r"(?iU)\b(?:api[_-]?key|secret|token|passwd|password)\s*[:=]\s*[^\s,;\"']{6,}",
        ),
        ("tool_token", _BEFORE + r"[A-Za-z0-9_-]{60,}\.[A-Za-z0-9_-]{80,}" + _AFTER),
        ("password_hash", r"\$argon2(?:id|i|d)\$[A-Za-z0-9$=+/,.-]{16,}"),
        ("session", rf"(?iU)\b{session_cookie}\s*=\s*[^\s;,\"']+"),
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
        ("aadhaar", r"(?U)" + _BEFORE + r"\d{4}[ -]?\d{4}[ -]?\d{4}" + _AFTER),
        ("pan", _BEFORE + r"[A-Z]{5}[0-9]{4}[A-Z]" + _AFTER),
        ("phone", r"(?U)" + _BEFORE + r"(?:\+91[ -]?|91[ -]?|0)?[6-9]\d{4}[ -]?\d{5}" + _AFTER),
    )


def least_secret(session_cookie: str = SESSION_COOKIE) -> int:
    """Characters of the shortest match of any pattern, but for e-mail addresses."""
    plain = re.fullmatch(r"[A-Za-z0-9_]+", session_cookie)
    return min(10, len(session_cookie) + 2) if plain else 0


def may_hold_secret(text: Column, **options) -> Column:
    """False for a text that is too short for any pattern and no e-mail address."""
    return (F.length(text) >= least_secret(**options)) | F.contains(text, F.lit("@"))


def find_secrets(text: str | Column, **options) -> Column:
    """Kinds found, one entry per matching pattern, in pattern order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_compact(
        F.array(
            *[
                F.when(F.regexp_like(t, F.lit(pattern)), F.lit(kind))
                for kind, pattern in secret_patterns(**options)
            ]
        )
    )


def contains_secret(text: str | Column, **options) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    found = F.size(find_secrets(t, **options)) > 0
    return F.when(may_hold_secret(t, **options), found).otherwise(F.lit(False))


def scrub(text: str | Column, **options) -> Column:
    """Replace every detected span by ``[REDACTED:kind]``, one pattern after the other."""

    def scrubbed(t: Column) -> Column:
        out = t
        for kind, pattern in secret_patterns(**options):
            out = F.regexp_replace(out, pattern, f"[REDACTED:{kind}]")
        return F.when(may_hold_secret(t, **options), out).otherwise(t)

    return let(F.col(text) if isinstance(text, str) else text, scrubbed)


CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
SECRET_KEY = r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|authorization|bearer|private[_-]?key)"
REDACTED = "[REDACTED]"


def is_secret_key(name: str | Column) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return F.regexp_like(n, F.lit(SECRET_KEY)) | contains_secret(n)


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def safe_text(text: str | Column, **options) -> Column:
    """Control characters out, secrets scrubbed, then entity-escaped."""
    t = F.col(text) if isinstance(text, str) else text
    return html_escape(scrub(F.regexp_replace(t, CONTROL, ""), **options))


# ---------------------------------------------------------------- hidden text in HTML
# fixed values: styles that hide text, in Java syntax
HIDDEN_STYLES = (
    r"(?iU)display\s*:\s*none",
    r"(?iU)visibility\s*:\s*hidden",
    r"(?iU)font-size\s*:\s*0*[01](?:\.\d+)?\s*(?:px|pt|em|rem|%)?\s*(?:;|\"|'|$)",
    r"(?iU)opacity\s*:\s*0(?:\.0+)?\s*(?:;|\"|'|$)",
)
STYLE_ATTRIBUTE = r"(?iU)style\s*=\s*(\"[^\"]*\"|'[^']*')"
WHITE_TEXT = r"(?iU)(?<![-\w])color\s*:\s*(#fff(?:fff)?|white)\b"
WHITE_GROUND = r"(?iU)background(?:-color)?\s*:\s*(#fff(?:fff)?|white)\b"
INSTRUCTION = (
    r"(?i)ignore (?:all |the )?(?:previous|prior)|system note|instead|disregard|you must"
)


def visible_text(html: str | Column) -> Column:
    """Tags become blanks, blanks collapse; text hidden by style stays in."""
    h = F.col(html) if isinstance(html, str) else html
    return strip(F.regexp_replace(F.regexp_replace(h, "<[^>]+>", " "), r"(?U)\s+", " "))


def has_hidden_text(html: str | Column) -> Column:
    h = F.col(html) if isinstance(html, str) else html

    def hides(style: Column) -> Column:
        closed = F.concat(style, F.lit(";"))
        hit = F.regexp_like(style, F.lit(WHITE_TEXT)) & F.regexp_like(style, F.lit(WHITE_GROUND))
        for pattern in HIDDEN_STYLES:
            hit = hit | F.regexp_like(closed, F.lit(pattern))
        return hit

    return F.exists(F.regexp_extract_all(h, F.lit(STYLE_ATTRIBUTE), 1), hides)


def hidden_text_score(html: str | Column) -> Column:
    """1.0 hidden text with an instruction phrase, 0.9 hidden text, else 0.0."""
    hidden = has_hidden_text(html)
    told = F.regexp_like(visible_text(html), F.lit(INSTRUCTION))
    return F.when(hidden & told, F.lit(1.0)).when(hidden, F.lit(0.9)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- manipulation phrases
# fixed values: (pattern, what it shows); two patterns share one meaning
RED_FLAGS = (
    (
        r"\b(ignore|disregard|forget|override)\b.{0,40}\b(instruction|rule|polic|previous|above|prior)",
        "tries to override the agent's instructions",
    ),
    (
        r"\b(note|message|instruction)s?\s+(to|for)\s+(the\s+)?(ai|assistant|agent|bot|model)\b",
        "speaks to the AI directly",
    ),
    (
        r"\b(system|admin|developer|root)\s*(:|mode|prompt|override)",
        "claims system or admin control",
    ),
    (
        r"\b(you are now|act as|pretend|jailbreak|do anything now)\b",
        "tries to change the agent's role",
    ),
    (
        r"\b(approv\w*|authori[sz]\w*|permission)\s+(is\s+)?(already|pre)"
        r"[- ]?(given|granted|approved|done)?",
        "claims approval was already given",
    ),
    (r"\balready\s+(approved|authori[sz]ed|verified)\b", "claims approval was already given"),
    (
        r"\b(urgent|immediately|right now|asap|act fast|within \d+ ?min)",
        "uses pressure or urgency",
    ),
    (
        r"\b(ceo|cfo|director|boss|manager|bank official|rbi|police|finance team)\b",
        "claims to be someone in authority",
    ),
    (
        r"\b(also|additionally|secretly|quietly|silently)\s+(pay|send|transfer)",
        "hides an extra payment in the text",
    ),
    (r"\b(do not|don't)\s+(tell|inform|notify|log|ask)", "asks to hide the action"),
    (r"<[^>]+>|white text|hidden text|display:\s*none", "contains hidden markup"),
)
MODEL_FLAGGED = "the AI injection detector flagged it"
MODEL_MISSING = "the AI detector could not run"


def red_flags(text: str | Column) -> Column:
    """Distinct meanings of the matching patterns, in order of first match."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(
        F.array_compact(
            F.array(
                *[
                    F.when(F.regexp_like(t, F.lit("(?iuU)" + pattern)), F.lit(label))
                    for pattern, label in RED_FLAGS
                ]
            )
        )
    )


# ---------------------------------------------------------------- fields in documents
INVOICE_VPA = r"(?U)Payee VPA\s*:\s*([A-Za-z0-9._-]+@[A-Za-z0-9._-]+)"
INVOICE_AMOUNT = r"(?U)Amount\s*:\s*(?:₹|Rs\.?|INR)?\s*(\d[\d,]*)(?:\.(\d{1,2}))?"
INVOICE_ID = r"(?U)Invoice Number\s*:\s*([A-Z]{2,5}-\d+)"
SPOKEN_AMOUNTS = (
    r"(?iuU)(?:₹|\brs\.?|\binr)\s*(\d[\d,]*)(?:\.(\d{1,2}))?",
    r"(?iuU)\b(\d[\d,]*)(?:\.(\d{1,2}))?\s*(?:rupees|rs\b|inr\b)",
)
SPOKEN_VPA = r"[A-Za-z0-9][A-Za-z0-9._-]*@[A-Za-z0-9][A-Za-z0-9._-]*"
VPA_SHAPE = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,63}@[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"
ADDRESS = r"([A-Za-z0-9][A-Za-z0-9._-]*)@([A-Za-z0-9][A-Za-z0-9._-]*)"
CUSTOMER = r"(?U)\bC-\d{3,6}\b"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _paise(text: Column, pattern: str) -> Column:
    return plain_number(_group(text, pattern, 1)) * 100 + fraction_paise(
        _group(text, pattern, 2)
    )


def invoice_payee(html: str | Column) -> Column:
    return _group(visible_text(html), INVOICE_VPA, 1)


def invoice_amount(html: str | Column) -> Column:
    return _paise(visible_text(html), INVOICE_AMOUNT)


def invoice_number(html: str | Column) -> Column:
    return _group(visible_text(html), INVOICE_ID, 1)


# field name -> extractor; callers may add their own Column builders
EXTRACTORS = {
    "payee_vpa": invoice_payee,
    "amount_paise": invoice_amount,
    "invoice_id": invoice_number,
}


def spoken_amount(text: str | Column) -> Column:
    """Amount in paise of the first currency phrase, NULL without one."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[_paise(t, pattern) for pattern in SPOKEN_AMOUNTS])


def spoken_intent(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.regexp_like(F.lower(t), F.lit(r"(?U)\b(pay|transfer|send)\b")), "pay").otherwise(
        "other"
    )


def spoken_payee(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return _group(t, SPOKEN_VPA, 0)


def amount_tokens(text: str | Column) -> Column:
    """Every number in the text, once as written (truncated) and once in hundredths."""
    t = F.col(text) if isinstance(text, str) else text
    pattern = r"(?iuU)(?:₹|rs\.?\s*|inr\s*)?(\d[\d,]*)(?:\.(\d{1,2}))?"
    whole = F.regexp_extract_all(t, F.lit(pattern), 1)
    cents = F.regexp_extract_all(t, F.lit(pattern), 2)
    pairs = F.arrays_zip(whole.alias("w"), cents.alias("c"))
    as_written = F.transform(pairs, lambda p: plain_number(p["w"]))
    hundredths = F.transform(
        pairs, lambda p: plain_number(p["w"]) * 100 + fraction_paise(p["c"])
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(as_written, hundredths))))


# ---------------------------------------------------------------- intents and requests
DEFAULT_AMOUNT = 100_000


def _addresses(text: Column, with_dot: bool) -> Column:
    """Addresses whose domain has (or lacks) a dot; sentence punctuation is cut off."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(ADDRESS), 1).alias("a"),
        F.regexp_extract_all(text, F.lit(ADDRESS), 2).alias("b"),
    )
    cut = F.transform(
        pairs,
        lambda p: F.struct(p["a"].alias("a"), F.regexp_replace(p["b"], "[.\\-_]+$", "").alias("b")),
    )
    kept = F.filter(
        cut, lambda p: F.contains(p["b"], F.lit(".")) if with_dot else ~F.contains(p["b"], F.lit("."))
    )
    return F.transform(kept, lambda p: F.concat_ws("@", p["a"], p["b"]))


def parse_intent(text: str | Column) -> Column:
    """Struct(kind, tool, target, amount_paise): the first matching rule wins."""
    t = F.col(text) if isinstance(text, str) else text
    low = F.lower(t)
    vpas, mails = _addresses(t, False), _addresses(t, True)
    has_vpa, has_mail = F.size(vpas) > 0, F.size(mails) > 0

    def says(pattern: str) -> Column:
        return F.regexp_like(low, F.lit("(?U)" + pattern))

    kind = ordered_case(
        [
            (says("(export|dump|exfiltrate)") & (has_mail | has_vpa), "export"),
            (has_vpa & says(r"\b(add|register|save)\b.*\b(payee|beneficiary)\b"), "add_payee"),
            (has_vpa & says(r"\b(pay|transfer|send|remit|wire)\b"), "pay"),
            (has_mail & says(r"\b(e-?mail|mail|forward|send|write)\b"), "email"),
        ],
        "none",
    )
    tools = {
        "export": "crm_export_records",
        "add_payee": "upi_add_payee",
        "pay": "upi_pay_upi",
        "email": "mail_send_email",
    }
    tool = F.try_element_at(F.create_map(*[F.lit(x) for p in tools.items() for x in p]), kind)
    target = (
        F.when(kind == "export", F.coalesce(F.get(mails, 0), F.get(vpas, 0)))
        .when(kind == "add_payee", F.get(vpas, 0))
        .when(kind == "pay", F.element_at(F.when(has_vpa, vpas), -1))
        .when(kind == "email", F.get(mails, 0))
    )
    found = [F.nullif(_paise(t, pattern), F.lit(0)) for pattern in SPOKEN_AMOUNTS]
    amount = F.when(kind == "pay", F.coalesce(*found, F.lit(DEFAULT_AMOUNT)))
    return F.struct(
        kind.alias("kind"), tool.alias("tool"), target.alias("target"), amount.alias("amount_paise")
    )


def request_purpose(text: str | Column) -> Column:
    """Purpose from the words of the user."""
    t = F.col(text) if isinstance(text, str) else text
    return ordered_case(
        [
            (
                F.regexp_like(t, F.lit(r"(?iuU)\b(marketing|promotion|promo|offers?|advert)")),
                "marketing",
            ),
            (F.regexp_like(t, F.lit(r"(?iuU)\b(reminder|remind)")), "payment_reminders"),
        ],
        "order_support",
    )


LOOKUP_VERB = (
    r"(?iuU)\b(show|look ?up|check|get|fetch|read|view|find|open|status|details?)\b"
)


# ---------------------------------------------------------------- submissions
# fixed values: control, zero-width and bidirectional characters removed before display
INVISIBLE = (
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f"
    r"\u200b-\u200f\u2028-\u202e\u2060-\u2064]"
)
MAX_SUBMISSION = 2000
WITHHELD = "[withheld by display filter]"
# fixed values: terms that withhold a text from display (callers extend the list)
BLOCKED_TERMS = (
    "porn",
    "nude",
    "nudes",
    "orgasm",
    "rape",
    "rapist",
    "incest",
    "sex",
    "sexual",
    "kys",
    "suicide",
    "kill yourself",
    "kill myself",
    "self harm",
    "selfharm",
    "cut myself",
    "hang myself",
    "end my life",
)


def _unicode_form(text: Column, form: str, *, drop_marks: bool = False) -> Column:
    """Unicode normal form of non-ASCII text; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def normal_form(values: pd.Series) -> pd.Series:
        import unicodedata

        def one(value):
            if value is None or value.isascii():
                return value
            value = unicodedata.normalize(form, value)
            return "".join(c for c in value if not unicodedata.combining(c)) if drop_marks else value

        return values.map(one)

    return normal_form(text)


def normalise_submission(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(_unicode_form(t, "NFC"), INVISIBLE, "")


def is_blocked(text: str | Column, terms: Sequence[str] = BLOCKED_TERMS) -> Column:
    """Block-list hit after folding accents, look-alike digits and stretched letters."""
    t = F.col(text) if isinstance(text, str) else text
    plain = _unicode_form(F.lower(t), "NFKD", drop_marks=True)
    folded = F.regexp_replace(F.translate(plain, "013457@$", "oieastas"), r"(.)\1{2,}", "$1$1")
    words = "|".join(r"[\s_-]*".join(term.split(" ")) for term in terms)
    return F.regexp_like(folded, F.lit(rf"(?U)(?<![a-z])(?:{words})(?![a-z])"))


def submission_code(raw: str | Column) -> Column:
    """NULL when the text is acceptable, else the reason code."""
    r = F.col(raw) if isinstance(raw, str) else raw
    return (
        F.when(r.isNull(), "invalid_text")
        .when(F.length(r) > MAX_SUBMISSION, "too_long")
        .when(F.length(strip(normalise_submission(r))) == 0, "empty")
    )
