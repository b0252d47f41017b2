"""The character set of bytes, by byte order marks and statistics, in one vectorised pass over each file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Byte order marks, longer ones first.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: Bytes that cp1252 does not define.
UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def _decodes(raw: bytes, name: str) -> str | None:
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


def _of_script(text: str, low: str, high: str) -> float:
    """The part of the characters beyond ASCII that lie in a range."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    far = c > 127
    return float(((c >= ord(low)) & (c <= ord(high))).sum() / max(far.sum(), 1))


def guess(raw: bytes) -> str:
    """The likeliest character set of a file.

    A mark decides; then sound UTF-8; then zero bytes at every other place (UTF-16).  Bytes above 127 that
    stand alone between letters are Western: cp1252 where its own range is used, else Latin-1.  Where they come in
    runs, Japanese is told by its kana and Cyrillic by which half of the range holds most letters, as small
    letters are more frequent than capitals.
    """
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    if _decodes(raw, "utf-8") is not None and b"\x00" not in raw:
        return "utf-8"
    a = np.frombuffer(raw, np.uint8)
    pairs = len(a) // 2
    zeros = [float((a[i : 2 * pairs : 2] == 0).mean()) if pairs else 0.0 for i in (0, 1)]
    if max(zeros) > 0.3 and min(zeros) < 0.1:
        return "utf-16-le" if zeros[1] > zeros[0] else "utf-16-be"
    if _decodes(raw, "utf-8") is not None:
        return "utf-8"
    high = np.concatenate([[False], a >= 0x80, [False]])
    beside = high[1:-1] & (high[:-2] | high[2:])
    count = np.bincount(a, minlength=256)
    western = "cp1252" if count[0x80:0xA0].any() and not count[list(UNDEFINED)].any() else "latin-1"
    for name in ("shift_jis", "euc_jp"):
        text = _decodes(raw, name)
        # Half-width kana are what Western bytes would be in Shift-JIS, so they do not count.
        if text is not None and _of_script(text, "\u3040", "\u30ff") > 0.2:
            return name
    if beside.sum() < 0.5 * high.sum():
        return western
    upper, lower = count[0xC0:0xE0].sum(), count[0xE0:0x100].sum()
    if upper + lower < 0.8 * count[0x80:].sum():
        return western
    return "cp1251" if lower > upper else "koi8-r"


@F.arrow_udf(StructType([StructField("content", StringType()), StructField("charset", StringType())]))
def _decoded(raws: pa.Array) -> pa.Array:
    rows = []
    for x in raws:
        raw = x.as_py()
        name = None if raw is None else guess(raw)
        rows.append(None if raw is None else {"content": raw.decode(name, "replace"), "charset": name})
    return pa.array(rows, pa.struct([("content", pa.string()), ("charset", pa.string())]))


def decoded(content: Column) -> Column:
    """struct(content, charset) of a file's bytes; plain UTF-8 does not leave the JVM."""
    text = content.cast("string")
    plain = F.is_valid_utf8(text) & (F.instr(text, "\x00") == 0) & ~text.startswith("\ufeff")
    return F.when(plain, F.struct(text.alias("content"), F.lit("utf-8").alias("charset"))).otherwise(_decoded(F.when(~plain, content)))
