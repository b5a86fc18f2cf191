"""Labels, buckets, tags and other text expressions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel counts with a bucket of their own, below and above the border.
LOW_CHANNELS, HIGH_CHANNELS, CHANNEL_BORDER = (19, 21, 22), (125, 128, 129), 64
LOW_REST, HIGH_REST = "Others LO (≤ 64 ch)", "Others HI (> 64 ch)"
TAG_SEPARATOR = ", "
#: Signed integers of recording, session and offset.
WINDOW_ID = r"^(-?\d+)_-_(-?\d+)_-_(-?\d+)$"


def point_label(dataset: Column, modality: Column, n_channels: Column, recording: Column, group: Column | None = None) -> Column:
    """Text of a point; null if any part is (concat, not concat_ws)."""
    parts = [dataset, F.lit(" · "), modality, F.lit(" · "), n_channels.cast("string"), F.lit(" ch · rec "), recording.cast("string")]
    if group is not None:
        parts += [F.lit(" · group "), group.cast("string")]
    return F.concat(*parts)


def channel_predicates(n: Column) -> dict[str, Column]:
    """Named predicates; each row with a channel count satisfies exactly one."""
    out = {f"{k} ch": n == k for k in LOW_CHANNELS}
    out[LOW_REST] = (n <= CHANNEL_BORDER) & ~n.isin(*LOW_CHANNELS)
    out |= {f"{k} ch": n == k for k in HIGH_CHANNELS}
    out[HIGH_REST] = (n > CHANNEL_BORDER) & ~n.isin(*HIGH_CHANNELS)
    return out


def channel_bucket(n: Column) -> Column:
    out = F.when(n <= CHANNEL_BORDER, LOW_REST).otherwise(HIGH_REST)
    for k in (*LOW_CHANNELS, *HIGH_CHANNELS):
        out = F.when(n == k, f"{k} ch").otherwise(out)
    return out


def canonical_tags(tags: Column) -> Column:
    """Hand-edited separators made equal."""
    return F.regexp_replace(F.trim(tags), r"\s*,\s*", TAG_SEPARATOR)


def has_tag(tags: Column, tag: str) -> Column:
    return F.array_contains(F.split(tags, TAG_SEPARATOR), tag)


def parse_window_id(window_id: Column) -> Column:
    """struct(recording, session, offset), null if the text is no window id."""
    part = lambda i: F.regexp_extract(window_id, WINDOW_ID, i).cast("long")
    return F.when(window_id.rlike(WINDOW_ID), F.struct(part(1).alias("recording"), part(2).alias("session"), part(3).alias("offset")))


def mask_column(direction: Column | str, eta: Column, kernel: Column) -> Column:
    """Name of a mask column, such as dpp_top_eta_010_additive."""
    direction = F.lit(direction) if isinstance(direction, str) else direction
    return F.format_string("dpp_%s_eta_%03d_%s", direction, F.bround(eta * 100).cast("int"), kernel)


def mask_name(direction: str, eta: float, kernel: str) -> str:
    return f"dpp_{direction}_eta_{round(100 * eta):03d}_{kernel}"


def quoted(name: str) -> str:
    """A column's or a view's name as an identifier of Spark SQL. Refused: no text, and ``${``, which Spark takes for a variable."""
    if not name or "${" in name:
        raise ValueError(f"{name!r} can't be an identifier of a SQL text")
    return "`" + name.replace("`", "``") + "`"


def literal(value: str | int | float | bool | None) -> str:
    """A value as a literal of Spark SQL. Texts keep quotes, backslashes, line ends and ``${``; floats are exact doubles."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ValueError(f"{value} is no 64-bit integer")
        return f"{value}L" if value > -(2**63) else f"(-{2**63 - 1}L - 1L)"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def view_name(name: str, scope: str = "vectide") -> str:
    """A name for a view made of any text: its letters and digits, then a checksum that tells apart names which look alike."""
    plain = re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")[:40]
    return f"{scope}_{plain}_{hashlib.md5(name.encode()).hexdigest()[:12]}"
