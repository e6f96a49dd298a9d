"""Kernels on pixel arrays (height, width, channels) and maps (height, width), for use in Arrow batches.

Every function leaves its input as it is. Randomness comes from a key, so a row gives the same pixels on any executor.
"""

from __future__ import annotations

import numpy as np


def rng(*key: int) -> np.random.Generator:
    return np.random.default_rng([k & 0xFFFFFFFF for k in key])


def _sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, edge: bool) -> np.ndarray:
    """Values between four pixels; outside the image the nearest pixel's, or 0 if not ``edge``."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = 0.0
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            part = (1 - np.abs(x - xi)) * (1 - np.abs(y - yi))
            if not edge:
                part = part * ((xi >= 0) & (xi < w) & (yi >= 0) & (yi < h))
            value = image[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)].astype(np.float64)
            out = out + (part[..., None] if image.ndim == 3 else part) * value
    return np.clip(np.rint(out), 0, 255).astype(image.dtype) if image.dtype == np.uint8 else out.astype(image.dtype)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres at halves."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    return _sample(image, *np.meshgrid(x, y), edge=True)


def _margins(total: int) -> tuple[int, int]:
    return total // 2, total - total // 2


def pad(image: np.ndarray, rows: tuple[int, int], cols: tuple[int, int]) -> np.ndarray:
    return np.pad(image, (rows, cols) + ((0, 0),) * (image.ndim - 2))


def fit(image: np.ndarray, height: int, width: int, symmetric: bool = True) -> tuple[np.ndarray, tuple[int, int]]:
    """Resized to fit a canvas, its shape kept, the rest black; with the (left, top) margin."""
    h, w = image.shape[:2]
    scale = min(height / h, width / w)
    inner = max(1, min(height, int(h * scale))), max(1, min(width, int(w * scale)))
    small = resize(image, *inner)
    rows, cols = height - inner[0], width - inner[1]
    top, left = (_margins(rows)[0], _margins(cols)[0]) if symmetric else (0, 0)
    return pad(small, (top, rows - top), (left, cols - left)), (left, top)


def fit_boxes(boxes: np.ndarray, raw: tuple[int, int], inner: tuple[int, int], final: tuple[int, int], offset: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Relative boxes of an image of shape ``raw`` resized to ``inner`` on a canvas ``final`` with a (left, top) margin."""
    out = np.asarray(boxes, np.float64).copy()
    out[..., [0, 2]] = (out[..., [0, 2]] * inner[1] + offset[0]) / final[1]
    out[..., [1, 3]] = (out[..., [1, 3]] * inner[0] + offset[1]) / final[0]
    return np.clip(out, 0, 1)


def rotate(image: np.ndarray, degrees: float, expand: bool = False, keep_size: bool = False) -> np.ndarray:
    """Turned against the clock about the centre; ``expand`` pads first and again to the first shape's proportions,
    ``keep_size`` then brings it back to the first size."""
    h, w = image.shape[:2]
    a = np.radians(degrees)
    c, s = np.cos(a), np.sin(a)
    if expand:
        need = abs(w * s) + abs(h * c), abs(w * c) + abs(h * s)
        image = pad(image, _margins(max(0, int(np.ceil(need[0] - h)))), _margins(max(0, int(np.ceil(need[1] - w)))))
    eh, ew = image.shape[:2]
    x, y = np.meshgrid(np.arange(ew) - ew / 2, np.arange(eh) - eh / 2)
    out = _sample(image, c * x - s * y + ew / 2, s * x + c * y + eh / 2, edge=False)
    if expand:
        if eh * w > ew * h:
            out = pad(out, (0, 0), _margins(int(eh * w / h - ew)))
        elif eh * w < ew * h:
            out = pad(out, _margins(int(ew * h / w - eh)), (0, 0))
        if keep_size:
            out = resize(out, h, w)
    return out


def without_border(image: np.ndarray) -> np.ndarray:
    """Without black rows and columns around it; a black image stays."""
    inked = image.reshape(*image.shape[:2], -1).any(2)
    rows, cols = np.flatnonzero(inked.any(1)), np.flatnonzero(inked.any(0))
    return image[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) else image


def crops(image: np.ndarray, boxes: np.ndarray) -> list[np.ndarray]:
    """Parts at boxes: integers are pixels, others shares of the size, whose last pixel is included."""
    boxes = np.asarray(boxes)
    if boxes.size == 0:
        return []
    if boxes.ndim != 2 or boxes.shape[1] != 4:
        raise ValueError("boxes need four columns")
    if not np.issubdtype(boxes.dtype, np.integer):
        h, w = image.shape[:2]
        boxes = np.rint(boxes * (w, h, w, h)).astype(int) + (0, 0, 1, 1)
    return [np.ascontiguousarray(image[max(b, 0) : d, max(a, 0) : c]) for a, b, c, d in boxes]


def turned_crop(image: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """The part at four relative corners (clockwise from the top left), laid straight; empty below a pixel."""
    h, w = image.shape[:2]
    p = np.asarray(poly, np.float64) * (w, h)
    width, height = int(np.hypot(*(p[1] - p[0]))), int(np.hypot(*(p[3] - p[0])))
    if width < 1 or height < 1:
        return image[:0, :0]
    u, v = np.meshgrid(np.arange(width) / max(1, width - 1), np.arange(height) / max(1, height - 1))
    at = p[0] + u[..., None] * (p[1] - p[0]) + v[..., None] * (p[3] - p[0])
    return _sample(image, at[..., 0], at[..., 1], edge=False)


def upright(crop: np.ndarray, turns: int) -> np.ndarray:
    """A crop found turned by ``turns`` quarters against the clock, turned back."""
    return np.rot90(crop, (4 - turns) % 4)


def inside(height: int, width: int, poly: np.ndarray) -> np.ndarray:
    """Pixels whose centres are in or on a polygon of pixel corners."""
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    odd, on = np.zeros((height, width), bool), np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(poly, np.roll(poly, -1, 0)):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on |= (cross == 0) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd | on


def mask(image: np.ndarray, boxes: np.ndarray, fill: int = 255) -> np.ndarray:
    """With relative boxes (n, 4) or polygons (n, 4, 2) filled; edges belong to them."""
    boxes = np.asarray(boxes, np.float64)
    if boxes.size == 0:
        return image
    polys = boxes if boxes.ndim == 3 else boxes[:, [0, 1, 2, 1, 2, 3, 0, 3]].reshape(-1, 4, 2)
    h, w = image.shape[:2]
    out = image.copy()
    for poly in np.rint(np.clip(polys * (w, h), 0, (w, h))).astype(int):
        out[inside(h, w, poly)] = fill
    return out


def dilate(x: np.ndarray, size: int) -> np.ndarray:
    """Largest value of the square around each place; what is outside does not count."""
    r = (size - 1) // 2
    low = np.iinfo(x.dtype).min if np.issubdtype(x.dtype, np.integer) else -np.inf
    wide = np.pad(x, r, constant_values=low)
    return np.lib.stride_tricks.sliding_window_view(wide, (2 * r + 1, 2 * r + 1)).max((2, 3))


def erode(x: np.ndarray, size: int) -> np.ndarray:
    return 1 - dilate(1 - x, size)


def opening(x: np.ndarray, size: int = 3) -> np.ndarray:
    return dilate(erode(x, size), size)


def components(x: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the pieces of touching places (corners too), in the order of their first place; 0 elsewhere.

    Labels spread along rows and columns until none changes, so the steps grow with a piece's turns, not its places.
    """
    on = np.asarray(x) != 0
    big = on.size + 1
    label = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), big)
    while True:
        before = label
        near = -dilate(-label, 3)
        label = np.where(on, near, big)
        for axis in (0, 1):
            for step in (1, -1):
                turned = label if axis == 1 else label.T
                cells, line = (turned[:, ::step], on if axis == 1 else on.T)
                # runs of places share their least label
                gate = line[:, ::step]
                run = np.cumsum(~gate, axis=1)
                shifted = cells - run * (big + 1)
                best = np.minimum.accumulate(shifted, axis=1) + run * (big + 1)
                best = np.where(gate, best, big)[:, ::step]
                label = best if axis == 1 else best.T
        if (label == before).all():
            break
    names = np.unique(label[on])
    return np.where(on, np.searchsorted(names, label) + 1, 0)


def box_score(prob: np.ndarray, points: np.ndarray, straight: bool = True) -> float:
    """Mean of a map in the bounds of points, or in their polygon; 0 if nothing is inside."""
    h, w = prob.shape[:2]
    points = np.asarray(points, np.float64).reshape(-1, 2)
    if straight:
        x0, y0 = np.clip(np.floor(points.min(0)), 0, (w - 1, h - 1)).astype(int)
        x1, y1 = np.clip(np.ceil(points.max(0)), 0, (w - 1, h - 1)).astype(int)
        return float(prob[y0 : y1 + 1, x0 : x1 + 1].mean())
    found = prob[inside(h, w, points.astype(int))]
    return float(found.mean()) if found.size else 0.0


def map_boxes(prob: np.ndarray, threshold: float = 0.3, least_score: float = 0.1, unclip: float = 1.5, least_side: int = 3) -> list[tuple[float, ...]]:
    """Straight relative boxes and scores of the opened pieces of a probability map.

    A piece whose longer side is under ``least_side`` or whose score is below ``least_score`` is left out; a box grows
    on every side by its area times ``unclip`` over its perimeter.
    """
    h, w = prob.shape
    pieces = components(opening((prob >= threshold).astype(np.int64)))
    out = []
    for k in range(1, pieces.max(initial=0) + 1):
        y, x = np.nonzero(pieces == k)
        x0, x1, y0, y1 = x.min(), x.max() + 1, y.min(), y.max() + 1
        if max(x1 - x0, y1 - y0) < least_side:
            continue
        score = box_score(prob, np.array([(x0, y0), (x1 - 1, y1 - 1)]))
        if score < least_score:
            continue
        grow = (x1 - x0) * (y1 - y0) * unclip / (2 * (x1 - x0 + y1 - y0))
        out.append((*np.clip([(x0 - grow) / w, (y0 - grow) / h, (x1 + grow) / w, (y1 + grow) / h], 0, 1).tolist(), score))
    return out


def to_planes(image: np.ndarray, scale: bool = True) -> np.ndarray:
    """Channels first; ``scale`` brings bytes to 0 to 1."""
    planes = np.ascontiguousarray(np.moveaxis(image, -1, 0))
    return planes.astype(np.float32) / 255 if scale and image.dtype == np.uint8 else planes


def normalized(planes: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    shape = (-1,) + (1,) * (planes.ndim - 1)
    return (planes - np.reshape(mean, shape)) / np.reshape(std, shape)


def inverted(image: np.ndarray, key: int, least: float = 0.6) -> np.ndarray:
    """Grey, each channel dimmed by a random share from ``least`` to 1, then inverted."""
    grey = image[..., :3] @ np.array([0.2989, 0.587, 0.114])
    shift = least + (1 - least) * rng(key).random(3)
    if image.dtype == np.uint8:
        return 255 - (np.floor(grey)[..., None] * shift).astype(np.uint8)
    return (1 - grey[..., None] * shift).astype(image.dtype)


def noisy(image: np.ndarray, key: int, mean: float = 0.0, std: float = 1.0) -> np.ndarray:
    """With even noise from mean - std to mean + std, in shares of the range."""
    noise = mean + std * (2 * rng(key).random(image.shape) - 1)
    if image.dtype == np.uint8:
        return np.clip(np.rint(image + 255 * noise), 0, 255).astype(np.uint8)
    return np.clip(image + noise, 0, 1).astype(image.dtype)


def shuffled_channels(image: np.ndarray, key: int) -> np.ndarray:
    return image[..., rng(key).permutation(image.shape[-1])]


def mirrored(image: np.ndarray) -> np.ndarray:
    return image[:, ::-1]


def blurred(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian along every axis, the last one too; edges are mirrored."""
    r = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = x.astype(np.float64)
    for axis in range(x.ndim):
        wide = np.pad(out, [(r, r) if k == axis else (0, 0) for k in range(x.ndim)], mode="symmetric")
        out = np.lib.stride_tricks.sliding_window_view(wide, 2 * r + 1, axis) @ weights
    return out
