"""Output settings: codec, level and row-group size; command line before file before default."""

from __future__ import annotations

CODECS = {"uncompressed", "snappy", "gzip", "brotli", "zstd", "lz4"}
#: Allowed levels and what the aliases stand for.
LEVELS = {"zstd": (1, 4, 2), "gzip": (-2, 9, -1), "brotli": (0, 11, 6), "lz4": (0, 9, 0)}
ALIASES = ("fast", "normal", "best")
#: zstd's four levels as the library numbers them.
ZSTD = {1: 1, 2: 3, 3: 7, 4: 11}
DEFAULT = "zstd"


class SettingsError(ValueError):
    pass


def resolve_compression(cli: dict, section: dict | None = None, source: str = "") -> tuple[str, int | None]:
    """(codec, level); field by field the command line, the rule file, the source's codec, zstd."""
    section = section or {}
    codec = str(cli.get("codec") or section.get("codec") or section.get("type") or source or DEFAULT).lower()
    level = cli.get("level") if cli.get("level") not in (None, "") else section.get("level")
    if codec not in CODECS:
        raise SettingsError(f'unknown codec "{codec}"')
    if level in (None, ""):
        return codec, None
    if codec not in LEVELS:
        raise SettingsError(f"{codec} takes no level")
    low, high, normal = LEVELS[codec]
    if str(level) in ALIASES:
        return codec, {"fast": max(low, 0) if codec != "gzip" else 1, "normal": normal, "best": high}[str(level)]
    try:
        n = int(level)
    except ValueError:
        raise SettingsError(f'level "{level}" is neither a number nor one of {", ".join(ALIASES)}') from None
    if not low <= n <= high:
        raise SettingsError(f"{codec} level must be {low} to {high}, not {n}")
    return codec, n


def resolve_row_group(cli: dict, section: dict | None = None) -> int | None:
    n = cli.get("max_rows") if cli.get("max_rows") is not None else (section or {}).get("max_rows")
    if n is None:
        return None
    if int(n) <= 0:
        raise SettingsError(f"the row limit must be positive, not {n}")
    return int(n)


def write_options(codec: str, level: int | None, max_rows: int | None) -> dict[str, str]:
    """Options of Spark's Parquet writer."""
    out = {"compression": "lz4_raw" if codec == "lz4" else codec}
    if level is not None and codec == "zstd":
        out["parquet.compression.codec.zstd.level"] = str(ZSTD[level])
    if level is not None and codec == "gzip":
        out["zlib.compress.level"] = str(level)
    if max_rows:
        out["parquet.block.row.count.limit"] = str(max_rows)
    return out
