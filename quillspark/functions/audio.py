"""PCM samples as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pcm16_column(data: Column) -> Column:
    """Little-endian 16-bit samples as numbers in -1..1: two hexadecimal digits a byte, low byte first; an odd last byte is dropped."""
    digits = F.hex(data)
    at = lambda i: F.conv(F.concat(F.substring(digits, i * 4 + 3, F.lit(2)), F.substring(digits, i * 4 + 1, F.lit(2))), 16, 10).cast("int")
    signed = lambda x: F.when(x > 32767, x - 65536).otherwise(x) / F.lit(32768.0)
    n = F.floor(F.octet_length(data) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: signed(at(i)))).otherwise(F.array().cast("array<double>"))


def mixed_down(samples: Column, channels: int) -> Column:
    """Means over the channels of each frame; a ragged tail is dropped."""
    n = F.floor(F.size(samples) / channels).cast("int")
    mean = lambda i: sum((F.get(samples, i * channels + c) for c in range(1, channels)), F.get(samples, i * channels)) / channels
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), mean)).otherwise(F.array().cast("array<double>"))
