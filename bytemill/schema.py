"""Names, fixed values and defaults in one place."""

from __future__ import annotations

#: Features of a chunk in the order of the vector: five scalars, 256 shares of byte values, the ten largest shares of byte pairs.
SCALARS = ["length", "entropy", "printable_ratio", "byte_mean", "byte_variance"]
TOP_PAIRS = 10
FEATURES = [*SCALARS, *(f"hist_{i}" for i in range(256)), *(f"bigram_top{i}" for i in range(TOP_PAIRS))]

#: Fixed values of the archive formats: codec names in the order of their ids, which are never reassigned.
CODECS = ["store", "gzip", "bzip2", "lzma", "zstd", "brotli"]
#: Not tried in a search, as it nearly never wins.
NOT_SEARCHED = {"gzip"}

#: Chunk sizes: archives, manifests and the command line; the labelled dataset.
ARCHIVE_CHUNK, DATASET_CHUNK = 4096, 16384
#: Content-aware chunking: window, least printable share, highest entropy, highest share of hex digits, least run.
WINDOW, PRINTABLE, ENTROPY, HEX, LEAST_RUN = 512, 0.85, 5.0, 0.95, 1024
#: Chunks above this length are outside what the selector was trained on.
OVERSIZE = 8 * ARCHIVE_CHUNK
CHUNKERS = ("fixed_size", "content_aware")


class ArchiveError(ValueError):
    """An archive that can't be what it claims."""


class DecodeError(ArchiveError):
    """A checked archive that can't be decoded."""


class EncodeError(ValueError):
    """A manifest or its source that can't be encoded."""


class ManifestError(ValueError):
    """A manifest that is malformed or doesn't fit its source."""


class MissingCodecError(ValueError):
    """A codec whose library isn't installed, or sizes of a codec that a dataset lacks."""


def check_chunking(chunker: str = "fixed_size", chunk_size: int = ARCHIVE_CHUNK, window: int = WINDOW, printable: float = PRINTABLE, entropy: float = ENTROPY, hexes: float = HEX, least_run: int = LEAST_RUN) -> None:
    """Raises ValueError unless all parameters are in range, whichever chunker uses them."""
    if chunker not in CHUNKERS:
        raise ValueError(f"unknown chunker {chunker!r}; known: {', '.join(CHUNKERS)}")
    for name, value in (("chunk_size", chunk_size), ("window", window), ("least_run", least_run)):
        if value <= 0:
            raise ValueError(f"{name} must be above 0")
    for name, value, most in (("printable", printable, 1), ("entropy", entropy, 8), ("hexes", hexes, 1)):
        if not 0 <= value <= most:
            raise ValueError(f"{name} must lie in 0..{most}")
