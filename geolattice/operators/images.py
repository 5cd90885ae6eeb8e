"""Images through injected decoders and models: decode, resize, gray, standardise, describe.

Neither codecs nor networks are part of the engine. A decoder turns bytes into an array of
height by width by three channels, red first; a model turns a batch into one vector an image.
Both are picklable functions that run in the tasks, a batch of bounded size at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Means and deviations of red, green and blue of a well-known image collection, and the weights of gray.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
GRAY = (0.299, 0.587, 0.114)


def gray(image: np.ndarray) -> np.ndarray:
    """Brightness from 0 to 1; an image of one channel is only scaled."""
    values = image.astype(np.float32) / 255
    return values @ np.array(GRAY, dtype=np.float32) if values.ndim == 3 else values


def standardized(image: np.ndarray) -> np.ndarray:
    """Channels first, brought to mean zero and deviation one of the collection."""
    return np.moveaxis((image.astype(np.float32) / 255 - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32), 2, 0)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear samples at pixel centres."""
    h, w = image.shape[:2]
    place = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    y, x = place(h, height), place(w, width)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    shape = (-1, 1, 1) if image.ndim == 3 else (-1, 1)
    fy, fx = (y - y0).reshape(shape), (x - x0).reshape((1, *shape[:-1]) if image.ndim == 3 else (1, -1))
    v = image.astype(np.float32)
    top = v[y0][:, x0] * (1 - fx) + v[y0][:, x1] * fx
    low = v[y1][:, x0] * (1 - fx) + v[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def describe(images: DataFrame, decoder: Callable[[bytes], np.ndarray], model: Callable[[np.ndarray], np.ndarray], size: tuple[int, int], batch: int = 16) -> DataFrame:
    """(entry_id, v, error) of images (entry_id, image): decoded, brought to ``size`` (height, width), standardised and given to the model.

    The model sees at most ``batch`` images at once. An image that does not decode gives a row
    with its error and no vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                good, errors = [], []
                for value in part.column("image"):
                    try:
                        good.append(standardized(resized(decoder(value.as_py()), *size)))
                        errors.append(None)
                    except Exception as e:
                        errors.append(str(e))
                found = iter(model(np.stack(good))) if good else iter(())
                vectors = [None if e is not None else np.asarray(next(found), dtype=np.float32).reshape(-1).tolist() for e in errors]
                yield pa.RecordBatch.from_arrays([part.column("entry_id"), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["entry_id", "v", "error"])

    kind = images.schema["entry_id"].dataType.simpleString()
    return images.select("entry_id", "image").mapInArrow(run, f"entry_id {kind}, v array<float>, error string")
