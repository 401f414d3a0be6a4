"""Extraction by libraries that may not be installed: each adapter says so when it is called, not when it is imported."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PIXELS, MAX_PAGES = 40_000_000, 500


def plain_text_lines(data: bytes) -> list[tuple[int, str, str, float | None]]:
    """Lines of a text file, form feeds ending pages, stripped, blank ones dropped."""
    out = []
    for page, body in enumerate(data.decode("utf-8", "replace").split("\f"), 1):
        out += [(page, x.strip(), "native", None) for x in body.splitlines() if x.strip()]
    return out


def pdf_lines(data: bytes) -> list[tuple[int, str, str, float | None]]:
    """Native text of a PDF by page, top to bottom. Pages without text give nothing: they are for an OCR adapter."""
    try:
        import pypdfium2
    except ImportError as e:
        raise RuntimeError("reading PDFs needs pypdfium2") from e
    out = []
    with pypdfium2.PdfDocument(data) as doc:
        for page in range(len(doc)):
            text = doc[page].get_textpage().get_text_range()
            out += [(page + 1, x.strip(), "native", None) for x in text.splitlines() if x.strip()]
    return out


def pdf_properties(data: bytes) -> dict[str, str]:
    """The document information under pdf_ names; an unreadable document has none."""
    try:
        import pypdfium2

        with pypdfium2.PdfDocument(data) as doc:
            info = doc.get_metadata_dict()
    except Exception:  # noqa: BLE001
        return {}
    names = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate")
    return {f"pdf_{n.lower()}": str(info[n]) for n in names if info.get(n)}


def image_pages(data: bytes, max_pages: int = MAX_PAGES, max_pixels: int = MAX_PIXELS) -> bytes:
    """A PDF of an image's frames; sizes are checked from the header before a frame is decoded."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("reading images needs Pillow") from e
    with Image.open(io.BytesIO(data)) as im:
        n = getattr(im, "n_frames", 1)
        if n > max_pages or im.width * im.height > max_pixels:
            raise ValueError("more pages or pixels than allowed")
        frames = []
        for k in range(n):
            im.seek(k)
            frames.append(im.convert("RGB"))
    out = io.BytesIO()
    frames[0].save(out, "PDF", save_all=True, append_images=frames[1:])
    return out.getvalue()


def raster_dpi(width_pt: float, height_pt: float, wanted: int = 300, max_pixels: int = MAX_PIXELS, least: int = 36) -> int:
    """The resolution at which a page stays within the pixel limit; below ``least`` it is refused."""
    inches = width_pt / 72 * height_pt / 72
    dpi = min(wanted, int((max_pixels / inches) ** 0.5)) if inches > 0 else 0
    if dpi < least:
        raise ValueError("page too large to be drawn")
    return dpi


@F.pandas_udf(T.StringType())
def content_id(content: pd.Series) -> pd.Series:
    """Identity of a document: BLAKE2b-128 of its bytes, as 32 hex digits."""
    return content.map(lambda b: None if b is None else hashlib.blake2b(bytes(b), digest_size=16).hexdigest())


@F.pandas_udf(T.StringType())
def claim_id(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Identity of a file refused before it was read, from name:size:mtime; the same on every try."""
    for marks in batches:
        yield marks.map(lambda s: None if s is None else hashlib.blake2b(s.encode(), digest_size=16).hexdigest())
