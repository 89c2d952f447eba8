"""Seeded draws by hashes that other engines have too, so that runs, retries and SQL agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str, seed: int | str = 0) -> Column:
    """A number in (0, 1) for the keys and a seed: the first 8 digits of md5(key:...:seed)."""
    text = F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


def uniform_sql(keys: str, seed: int | str = 0) -> str:
    """uniform() in SQL; keys: an expression of text."""
    return f"((('0x' || substr(md5({keys} || ':{seed}'), 1, 8))::bigint + 0.5) / 4294967296.0)"


def normal(*keys: Column | str, seed: int | str = 0) -> Column:
    """A standard normal number for the keys and a seed, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(*keys, seed=f"{seed}a"))) * F.cos(2 * 3.141592653589793 * uniform(*keys, seed=f"{seed}b"))


def normal_sql(keys: str, seed: int | str = 0) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(keys, f'{seed}a')})) * cos(2 * 3.141592653589793 * {uniform_sql(keys, f'{seed}b')}))"
