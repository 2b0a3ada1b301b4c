"""Small scalar Column builders: time text, money, JSON pointers, ids, encodings."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# fixed values: signing purposes, and the older key names that map onto them
KEY_PURPOSES = ("mandate-signer", "approval-signer", "tree-head-signer", "gateway-tool")
OLD_KEY_PURPOSES = {
    "gateway": "tree-head-signer",
    "approver": "approval-signer",
    "mandate-issuer": "mandate-signer",
}


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body`` of a value computed once, for bodies whose lambdas would compute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: str | Column) -> Column:
    """Trim any Unicode white space, tabs and newlines included."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def normalise(text: str | Column) -> Column:
    return F.lower(strip(text))


def normalised_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; two empty strings are at distance 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def plain_number(text: str | Column) -> Column:
    """``12,34,567`` -> 1234567; NULL when it is not a number."""
    return F.replace(_col(text), F.lit(","), F.lit("")).try_cast("bigint")


def rupees_text(paise: str | Column) -> Column:
    """Integer paise as ``rupees.pp``."""
    p = _col(paise)
    return F.concat(
        F.floor(p / 100).cast("string"), F.lit("."), F.lpad((p % 100).cast("string"), 2, "0")
    )


def fraction_paise(digits: str | Column) -> Column:
    """One or two decimals as paise: ``5`` -> 50, NULL or empty -> 0."""
    d = F.coalesce(F.nullif(_col(digits), F.lit("")), F.lit("0"))
    return F.rpad(d, 2, "0").cast("int")


def escape_token(token: str | Column) -> Column:
    return F.replace(
        F.replace(_col(token), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")
    )


def unescape_token(token: str | Column) -> Column:
    return F.replace(
        F.replace(_col(token), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")
    )


def is_pointer(path: str | Column) -> Column:
    """True for a well-formed JSON pointer below the root."""
    return F.regexp_like(_col(path), F.lit(r"\A(?:/(?:[^~/]|~[01])*)+\z"))


def is_prefix(prefix: Column, path: Column) -> Column:
    """True when ``prefix`` is the pointer itself or one of its ancestors."""
    return (prefix == path) | F.startswith(path, F.concat(prefix, F.lit("/")))


def pointer_ancestors(path: str | Column) -> Column:
    """The pointer and all of its ancestors below the root."""
    parts = F.split(_col(path), "/")
    return F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def variant_path(pointer: str) -> str:
    """Variant path of a constant JSON pointer; canonical digits address an array position."""
    out = "$"
    for raw in pointer[1:].split("/"):
        token = raw.replace("~1", "/").replace("~0", "~")
        is_index = token.isascii() and token.isdigit() and (token == "0" or token[0] != "0")
        out += f"[{token}]" if is_index else f"['{token}']"
    return out


def resolve_pointer(args: Column, pointer: str) -> Column:
    """Variant at a constant pointer; NULL when absent (a JSON null stays a variant null)."""
    return F.try_variant_get(args, variant_path(pointer), "variant")


def rfc3339(ts: str | Column) -> Column:
    return F.date_format(_col(ts), RFC3339)


def parse_rfc3339(text: str | Column) -> Column:
    return F.try_to_timestamp(_col(text), F.lit(RFC3339))


def is_canonical_time(text: str | Column) -> Column:
    """Second precision, UTC, ``Z`` suffix: parsing and formatting gives the same text."""
    t = _col(text)
    return F.coalesce(rfc3339(parse_rfc3339(t)) == t, F.lit(False))


def day_start(ts: str | Column) -> Column:
    return F.date_trunc("DAY", _col(ts))


def thousandths(score: str | Column) -> Column:
    """Score as an integer of thousandths, truncated towards zero."""
    return (_col(score) * 1000).cast("long")


def decibels(top: Column, bottom: Column) -> Column:
    floor = F.lit(1e-12)
    return 10.0 * F.log10(F.greatest(top, floor) / F.greatest(bottom, floor))


def base64url(data: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(
        F.translate(F.regexp_replace(F.base64(data), r"\s", ""), "+/", "-_"), F.lit("=")
    )


def base64url_decode(text: str | Column) -> Column:
    t = F.translate(_col(text), "-_", "+/")
    padded = F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64"))


def key_purpose(key_id: str | Column) -> Column:
    """Purpose a key id belongs to (``<purpose>-<12 hex>`` or a bare or older name), else NULL."""
    k = _col(key_id)
    old = F.create_map(*[F.lit(x) for pair in OLD_KEY_PURPOSES.items() for x in pair])
    named = F.regexp_extract(k, r"\A([a-z-]+)-[0-9a-f]{12}\z", 1)
    return (
        F.when(k.isin(*KEY_PURPOSES), k)
        .when(k.isin(*OLD_KEY_PURPOSES), F.element_at(old, k))
        .when(named.isin(*KEY_PURPOSES), named)
    )


def id_tag(prefix: str, seed: int, counter: str | Column) -> Column:
    """``prefix_NNNNNNhhhh``: six-digit counter and four hex digits of a hash."""
    n = _col(counter).cast("string")
    digest = F.sha2(F.concat(F.lit(f"{seed}:{prefix}:"), n), 256)
    digits = F.when(F.length(n) >= 6, n).otherwise(F.lpad(n, 6, "0"))
    return F.concat(F.lit(prefix + "_"), digits, F.substring(digest, 1, 4))


def after_first(text: str | Column, separator: str) -> Column:
    """Text after the first separator, or the whole text when there is none."""
    t = _col(text)
    at = F.instr(t, separator)
    return F.when(at > 0, F.substr(t, at + F.lit(len(separator)))).otherwise(t)


def ordered_case(pairs: Sequence[tuple[Column, object]], default: object) -> Column:
    """First matching condition wins."""
    column = None
    for condition, value in pairs:
        condition = F.coalesce(condition, F.lit(False))
        column = F.when(condition, value) if column is None else column.when(condition, value)
    return F.lit(default) if column is None else column.otherwise(default)


def mu_law(sample: str | Column, *, mu: int = 255) -> Column:
    """Compand to 8 bits and expand again (telephone channel); input is clipped to [-1, 1]."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _col(sample).cast("double")))
    scale = F.log1p(F.lit(float(mu)))
    compressed = F.signum(x) * F.log1p(mu * F.abs(x)) / scale
    level = F.bround((compressed + 1.0) / 2.0 * 255.0, 0) / 255.0 * 2.0 - 1.0
    return F.signum(level) * (F.pow(F.lit(1.0 + mu), F.abs(level)) - 1.0) / mu


def mu_law_steps(sample: str | Column, *, mu: int = 255) -> Column:
    """The signed 7-bit variant: compressed value rounded to 1/127 steps."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _col(sample).cast("double")))
    scale = F.log1p(F.lit(float(mu)))
    level = F.bround(F.signum(x) * F.log1p(mu * F.abs(x)) / scale * 127.0, 0) / 127.0
    return F.signum(level) * F.expm1(F.abs(level) * scale) / mu
