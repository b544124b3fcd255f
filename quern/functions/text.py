"""Text functions as columns: normalisation, masking, truncation, sizes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Personal-data patterns by category. Java reads them with Unicode classes.
PII = {
    "id_card": r"(?<![0-9A-Za-z])\d{6}(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[0-9Xx](?![0-9A-Za-z])",
    "phone": r"\b1[3-9]\d{9}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "bank_card": r"\b\d{13,19}\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b",
    "passport": r"\b(?:[EePpKkSsGgDd]\d{8})\b",
}
#: Credentials masked in free text, (pattern, what stays in front); the value becomes mask characters.
SECRETS = [(r"(api[_-]?key\s*[=:]\s*)([^\s]+)", "$1", 8), (r"(token\s*[=:]\s*)([^\s]+)", "$1", 8), (r"(password\s*[=:]\s*)([^\s]+)", "$1", 8), (r"hf_[a-zA-Z0-9]{34}", "", 12), (r"sk-[a-zA-Z0-9]{48}", "", 12)]
#: Patterns masked in logs, with their replacements.
LOG_MASKS = [
    (r"(api[_-]?key\s*[=:]\s*)([^\s]+)", "$1****"),
    (r"(token\s*[=:]\s*)([^\s]+)", "$1****"),
    (r"(password\s*[=:]\s*)([^\s]+)", "$1****"),
    (r"(secret\s*[=:]\s*)([^\s]+)", "$1****"),
    (r"(auth[_-]?token\s*[=:]\s*)([^\s]+)", "$1****"),
    (r"(access[_-]?token\s*[=:]\s*)([^\s]+)", "$1****"),
    (r"(bearer\s+)([^\s]+)", "$1****"),
    (r"hf_[a-zA-Z0-9]{34}", "hf_****"),
    (r"sk-[a-zA-Z0-9]{48}", "sk-****"),
    (r"ghp_[a-zA-Z0-9]{36}", "ghp_****"),
    (r"xox[baprs]-[0-9a-zA-Z-]{10,}", "xox-****"),
    (r"\b([a-zA-Z0-9._%+-]+)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b", "$1@****"),
    (r"\b1[3-9]\d{9}\b", "1**********"),
    (r"\b\d{17}[\dXx]\b", "******************"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "**** **** **** ****"),
]
#: White space as Python sees it: Java's Unicode class and the four separators it leaves out; the same as a list of characters.
BLANK = "[\\s\\x1c-\\x1f]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_MODES = ("collapse_newlines", "nfc", "fullwidth", "lowercase")


def quoted(text: str) -> str:
    """A Java replacement that is just this text."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def strip(c: Column) -> Column:
    """Without white space at both ends; runs of any length cost one pass."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, or a string of white space only. The search ends at the first other character."""
    return c.isNull() | ~c.rlike("(?U)[^\\s\\x1c-\\x1f]")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def normalize(c: Column, modes: list[str] | tuple[str, ...] = ()) -> Column:
    """Trim, make white space single spaces; then NFC, half width and lower case, in that order, as asked."""
    out = F.btrim(F.regexp_replace(c, f"(?U){BLANK}+", " "), F.lit(" "))
    if "nfc" in modes:  # Python gets a null for a text of ASCII characters, which is in normal form
        out = F.coalesce(nfc(F.when(out.rlike("[^\\x00-\\x7F]"), out)), out)
    if "fullwidth" in modes:
        out = F.translate(out, _WIDE, _NARROW)
    return F.lower(out) if "lowercase" in modes else out


def mask_pii(c: Column, categories: list[str] | tuple[str, ...], replacements: dict[str, str] | None = None) -> Column:
    """Mask categories in the order given; an e-mail address keeps its domain. Replacement: own, `default`, else <category>."""
    given = replacements or {}
    for name in categories:
        if name not in PII:
            continue
        new = quoted(given.get(name) or given.get("default") or ("<EMAIL>" if name == "email" else f"<{name}>"))
        pattern = PII[name].replace("+@[", "+@([", 1).replace("{2,}\\b", "{2,})\\b") if name == "email" else PII[name]
        c = F.regexp_replace(c, f"(?U){pattern}", f"{new}@$1" if name == "email" else new)
    return c


def has_pii(c: Column, category: str) -> Column:
    return F.coalesce(c.rlike(f"(?U){PII[category]}"), F.lit(False))


def mask_secrets(c: Column, mask: str = "*") -> Column:
    for pattern, front, n in SECRETS:
        c = F.regexp_replace(c, f"(?iu){pattern}", front + quoted(mask * n))
    return c


def mask_log(c: Column) -> Column:
    for pattern, new in LOG_MASKS:
        c = F.regexp_replace(c, f"(?iU){pattern}", new)
    return c


def encrypt(c: Column, key: str) -> Column:
    """Base64 of AES-GCM under a key of 16, 24 or 32 bytes; the same text gives another result each time."""
    return F.base64(F.aes_encrypt(c.cast("binary"), F.lit(key.encode()), F.lit("GCM")))


def decrypt(c: Column, key: str) -> Column:
    """What encrypt() took; null for what it has not made under this key."""
    return F.try_aes_decrypt(F.unbase64(c), F.lit(key.encode()), F.lit("GCM")).cast("string")


def drop_control(c: Column) -> Column:
    """Without carriage returns, byte-order marks and control characters other than tab and newline."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B-\\x1F\\uFEFF]", "")


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def human_size(c: Column, zero: str | None = None) -> Column:
    """Bytes as 0.0B .. 0.0TB; zero: what an empty file is called."""
    shown = lambda power, unit: F.format_string(f"%.1f{unit}", F.bround(c / 1024.0**power, 1))  # halves go to the even digit
    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(c / 1024.0**power < 1024, shown(power, unit)).otherwise(out)
    return out if zero is None else F.when(c == 0, F.lit(zero)).otherwise(out)


def to_day(c: Column) -> Column:
    """A date as yyyy-MM-dd: null becomes '', a number is a spreadsheet day, text that is no date stays."""
    text = c.cast("string")
    number = F.try_to_number(F.when(text.rlike(r"^\d{1,7}(\.\d+)?$"), F.regexp_extract(text, r"^\d+", 0)), F.lit("9999999")).cast("int")
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")])
    day = F.when(number.isNotNull(), F.date_add(F.lit("1900-01-01").cast("date"), number - 2)).otherwise(parsed.cast("date"))
    return F.when(c.isNull(), "").otherwise(F.coalesce(F.date_format(day, "yyyy-MM-dd"), text))


def boxed(c: Column) -> Column:
    r"""The trimmed content of the first \boxed{...}, or null."""
    pattern = r"\\boxed\{(.*?)\}"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1)))


def name_parts(c: Column) -> tuple[Column, Column]:
    """Provider and dataset of a name: cut at the first slash, else at the first underscore; else no provider."""
    at = F.when(F.instr(c, "/") > 0, F.instr(c, "/")).when(F.instr(c, "_") > 0, F.instr(c, "_")).otherwise(0)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(F.lit(None).cast("string")), F.when(at > 0, F.substring(c, at + 1, F.char_length(c))).otherwise(c)


def escape(word: str) -> str:
    """A pattern that matches just this word, in Java as in Python."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", word) if word.isascii() else "".join(f"\\{x}" if x in r"\.^$|?*+()[]{}-" else x for x in word)
