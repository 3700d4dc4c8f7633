"""Arithmetic on image hashes and similarity scores; image decoding happens upstream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column, missing: int = 100) -> Column:
    """Differing bits of two integer hashes; `missing` where either is 0 or null."""
    bad = F.coalesce(a, F.lit(0)).eqNullSafe(F.lit(0)) | F.coalesce(b, F.lit(0)).eqNullSafe(F.lit(0))
    return F.when(bad, missing).otherwise(F.bit_count(a.bitwiseXOR(b))).cast("bigint")


def hash_similarity(distance: Column, bits: int = 256) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / bits))


def combined(ssim: Column, hash_sim: Column) -> tuple[Column, Column]:
    value = (ssim + hash_sim) / 2
    return value, value > 0.6


def enhanced(ssim: Column, hash_sim: Column, flags: list[Column]) -> tuple[Column, Column]:
    share = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int")) / len(flags)
    value = 0.4 * ssim + 0.3 * hash_sim + 0.3 * share
    return value, (value > 0.85) & (ssim > 0.8) & (hash_sim > 0.7) & (share > 0.5)


def nearest(distances: Column, lookalike: int = 15) -> tuple[Column, Column]:
    """(least distance over the brands, whether it is a look-alike's); infinite without any."""
    least = F.coalesce(F.array_min(distances).cast("double"), F.lit(float("inf")))
    return least, least <= lookalike


_UI = {
    "login_form": ("login", "sign in", "username", "password", "email", "account"),
    "password_field": ("password", "pwd", "passcode"),
    "username_field": ("username", "email", "user id", "login id"),
    "submit_button": ("submit", "sign in", "log in", "continue", "enter"),
    "security_indicators": ("secure", "https", "ssl", "protected", "verified"),
}


def ui_elements(texts: Column, rectangles: Column) -> dict[str, Column]:
    """Elements by words of a screenshot's texts; two rectangles or more stand for a form."""
    from .lexical import any_of

    whole = F.lower(F.array_join(F.coalesce(texts, F.array().cast("array<string>")), " "))
    out = {n: any_of(whole, ws) for n, ws in _UI.items()}
    return {**out, "login_form": out["login_form"] | F.coalesce(rectangles >= 2, F.lit(False))}


def _resized(gray, height: int, width: int):
    """Mean of the pixels under each cell of a height by width grid."""
    import numpy as np

    rows = np.linspace(0, gray.shape[0], height + 1)
    cols = np.linspace(0, gray.shape[1], width + 1)
    sums = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    sums[1:, 1:] = gray.cumsum(0).cumsum(1)

    def at(r, c):  # the sums over fractional corners
        i, j = np.minimum(r.astype(int), gray.shape[0] - 1), np.minimum(c.astype(int), gray.shape[1] - 1)
        u, v = (r - i)[:, None], (c - j)[None, :]
        s = lambda a, b: sums[np.ix_(a, b)]
        return (1 - u) * (1 - v) * s(i, j) + u * (1 - v) * s(i + 1, j) + (1 - u) * v * s(i, j + 1) + u * v * s(i + 1, j + 1)

    total = at(rows, cols)
    area = (gray.shape[0] / height) * (gray.shape[1] / width)
    # without the noise of the sums, so that equal pixels stay equal
    return np.round((total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]) / area, 6)


def gradient_hash(gray) -> int:
    """63 bits: whether the image, at 9 columns by 8 rows, grows brighter downwards."""
    small = _resized(gray, 8, 9)
    return sum(1 << i for i, b in enumerate((small[1:] > small[:-1]).ravel().tolist()) if b)


def cosine_hash(gray, size: int = 16):
    """size * size bits: low cosine coefficients of the image above their median."""
    import numpy as np

    n = 4 * size
    k = np.arange(n)
    basis = np.cos(np.pi / n * (k[None, :] + 0.5) * k[:, None])[:size]
    low = basis @ _resized(gray, n, n) @ basis.T
    low = np.round(low, 6)
    return (low > np.median(low.ravel()[1:])).ravel()


def structural_similarity(a, b, height: int = 200, width: int = 300, step: int = 8) -> float:
    """Mean structural similarity over blocks of both images at one size, from 0 to 1."""
    import numpy as np

    x, y = (_resized(g, height, width).reshape(height // step, step, -1)[:, :, : width // step * step].reshape(height // step, step, width // step, step).swapaxes(1, 2).reshape(-1, step * step) for g in (a, b))
    mx, my = x.mean(1), y.mean(1)
    vx, vy, cov = x.var(1), y.var(1), ((x - mx[:, None]) * (y - my[:, None])).mean(1)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(np.clip(((2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean(), 0, 1))


def picture_stats(gray) -> tuple[float, float, float, int]:
    """(mean and deviation of brightness, share of edge pixels, distinct values)."""
    import numpy as np

    gy, gx = np.gradient(gray.astype(float)) if min(gray.shape) > 1 else (np.zeros(gray.shape), np.zeros(gray.shape))
    return float(gray.mean()), float(gray.std()), float((np.hypot(gx, gy) > 50).mean()), int(len(np.unique(gray)))


IMAGE = "gradient bigint, cosine string, brightness double, contrast double, edge_density double, tones int"


def image_features(images, width: str = "width", pixels: str = "pixels"):
    """images (width, pixels: gray values row by row, ...) plus the columns of IMAGE, decoded in Arrow batches; an image
    without pixels or of a wrong size has gradient 0 and null elsewhere."""
    import pandas as pd

    keep = images.schema.fieldNames()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields), IMAGE])

    def run(batches):
        import numpy as np

        for part in batches:
            out = []
            for w, p in zip(part[width], part[pixels]):
                if p is None or not w or not len(p) or len(p) % int(w):
                    out.append((0, None, None, None, None, None))
                    continue
                gray = np.asarray(p, float).reshape(-1, int(w))
                out.append((gradient_hash(gray), "".join("01"[b] for b in cosine_hash(gray).astype(int)), *picture_stats(gray)))
            yield pd.concat([part[keep].reset_index(drop=True), pd.DataFrame(out, columns=[c.split()[0] for c in IMAGE.split(", ")])], axis=1)

    return images.mapInPandas(run, schema)


def cosine_distance(a: Column, b: Column) -> Column:
    """Differing places of two hashes of equal length; 256 where one is missing."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.coalesce(F.aggregate(pairs, F.lit(0), lambda s, v: s + v), F.lit(256)).cast("bigint")
