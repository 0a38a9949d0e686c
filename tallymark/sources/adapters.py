"""Engines that read pixels, behind one interface: a name and a function over Arrow-backed pandas batches.

No recognition engine is part of this package. An adapter's failure is a row with a status, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

INTERNAL = "INTERNAL_ERROR"
#: The error code of each adapter.
CODES = {"tiles": "TAMPERING_PROCESSING_ERROR"}

Adapter = Callable[[pd.DataFrame], pd.DataFrame]
REGISTRY: dict[str, tuple[Adapter, str]] = {}


def register(name: str, schema: str) -> Callable[[Adapter], Adapter]:
    def keep(f: Adapter) -> Adapter:
        REGISTRY[name] = f, schema
        return f

    return keep


def run(images: DataFrame, name: str) -> DataFrame:
    """The rows that the adapter makes of images (scan_id, height, width, channels, data) with status "success", and for each
    image that it fails on one row with scan_id, status "failed", the adapter's error code and the error's text. An unknown
    or disabled adapter gives no rows."""
    if name not in REGISTRY:
        return images.limit(0).select("scan_id")
    adapter, schema = REGISTRY[name]
    ship(images.sparkSession)
    names, code = [part.split()[0] for part in schema.split(",")], CODES.get(name, INTERNAL)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(len(part)):
                one = part.iloc[k : k + 1]
                try:
                    yield adapter(one)[names].assign(status="success", error_code=None, error=None)
                except Exception as error:  # isolation of one image is the point; it shows as a row that tells why
                    lost = pd.DataFrame({"scan_id": one["scan_id"]}).reindex(columns=names)
                    yield lost.assign(status="failed", error_code=code, error=f"{type(error).__name__}: {error}"[:500])

    return images.mapInPandas(batches, f"{schema}, status string, error_code string, error string")


TILE = 32
#: The weights of blue, green and red in a gray level, and a row of the 5 x 5 Gaussian.
GRAY, GAUSS = (0.114, 0.587, 0.299), np.array([1, 4, 6, 4, 1]) / 16
#: Gradient (sum of both directions) from which a pixel counts as an edge; thin lines are not traced beyond it.
EDGE = 150


def smoothed(gray: np.ndarray) -> np.ndarray:
    """The Gaussian mean of whole levels, mirrored at the borders."""
    padded = np.pad(gray, 2, mode="reflect")
    rows = sum(w * padded[k : k + gray.shape[0]] for k, w in enumerate(GAUSS))
    return np.floor(sum(w * rows[:, k : k + gray.shape[1]] for k, w in enumerate(GAUSS)) + 0.5)


def gradient(gray: np.ndarray) -> np.ndarray:
    padded = np.pad(gray, 1, mode="reflect")
    across = padded[:, 2:] - padded[:, :-2]
    down = padded[2:] - padded[:-2]
    return np.abs(across[:-2] + 2 * across[1:-1] + across[2:]) + np.abs(down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:])


@register("tiles", "scan_id long, tile_x int, tile_y int, edge_density double, residual_median double")
def noise_tiles(image: pd.DataFrame) -> pd.DataFrame:
    """Edge density and median residual of each whole tile of one image; the last row and column of tiles are left out, also
    where the image ends with them."""
    row = image.iloc[0]
    pixels = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], -1).astype(np.float64)
    gray = np.floor(pixels[:, :, :3] @ np.array(GRAY) + 0.5) if pixels.shape[2] >= 3 else pixels[:, :, 0]
    found = []
    if min(gray.shape) > TILE:
        residual, edges = np.abs(gray - smoothed(gray)), gradient(gray) > EDGE
        for y in range(0, gray.shape[0] - TILE, TILE):
            for x in range(0, gray.shape[1] - TILE, TILE):
                own = np.s_[y : y + TILE, x : x + TILE]
                found.append((row["scan_id"], x // TILE, y // TILE, float(edges[own].mean()), float(np.median(residual[own]))))
    return pd.DataFrame(found, columns=["scan_id", "tile_x", "tile_y", "edge_density", "residual_median"])
