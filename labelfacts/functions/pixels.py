"""Images as numpy arrays: H x W x 3 in BGR order, or H x W. Pure functions, used inside mapInPandas."""

from __future__ import annotations

import numpy as np


def decode(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return image[:, :, 0] if channels == 1 else image[:, :, :3]


def to_gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def to_rgb(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[:, :, None], 3, 2) if image.ndim == 2 else image[:, :, ::-1]


def contrast(image: np.ndarray, factor: float = 2.0) -> np.ndarray:
    """Away from the mean grey by a factor."""
    mean = round(float(to_gray(image).mean()))
    return np.clip(mean + (image.astype(float) - mean) * factor, 0, 255).astype(np.uint8)


def border(image: np.ndarray, size: int = 10, value: int = 255) -> np.ndarray:
    return np.pad(image, [(size, size)] * 2 + [(0, 0)] * (image.ndim - 2), constant_values=value)


def crop(image: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    h, w = image.shape[:2]
    return image[max(y0, 0) : min(y1, h), max(x0, 0) : min(x1, w)]


def crop_white(image: np.ndarray, level: int = 250) -> np.ndarray:
    """Without the outer rows and columns that are white throughout; an all-white image stays."""
    dark = to_gray(image) < level
    rows, cols = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    return image[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) else image


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, mode: str = "clamp") -> np.ndarray:
    """Bilinear values at real positions; outside: "black", "periodic" or "clamp"."""
    h, w = image.shape[:2]
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x, y = (x % w, y % h) if mode == "periodic" else (np.clip(x, 0, w - 1), np.clip(y, 0, h - 1))
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    k, m = ((i + 1) % h, (j + 1) % w) if mode == "periodic" else (np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1))
    fy, fx = (y - i), (x - j)
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    v = (image[i, j] * (1 - fx) + image[i, m] * fx) * (1 - fy) + (image[k, j] * (1 - fx) + image[k, m] * fx) * fy
    if mode == "black":
        v = np.where(inside[..., None] if image.ndim == 3 else inside, v, 0)
    return np.rint(v).astype(np.uint8)


def resize(image: np.ndarray, width: int = 400) -> np.ndarray:
    """To a width, keeping the proportions."""
    h, w = image.shape[:2]
    height = max(1, round(h * width / w))
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    return sample(image, *np.meshgrid(x, y))


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    p = np.pad(image.astype(float), r, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def threshold(image: np.ndarray, mode: str = "binary", cutoff: float | None = 150, invert: bool = False, block: int = 11, offset: float = 2) -> np.ndarray:
    """binary, tozero, or adaptive (against the mean around). Without a cutoff the one that parts the greys best (Otsu) is used."""
    gray = to_gray(image)
    if mode == "adaptive":
        on = gray > box_mean(gray, block) - offset
    else:
        on = gray > (otsu(gray) if cutoff is None else cutoff)
    if mode == "tozero":
        return np.where(on != invert, gray, 0).astype(np.uint8)
    return np.where(on != invert, 255, 0).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    w = n.cumsum()
    s = (n * np.arange(256)).cumsum()
    with np.errstate(invalid="ignore", divide="ignore"):
        between = (s[-1] * w / w[-1] - s) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def _morph(image: np.ndarray, h: int, w: int, f) -> np.ndarray:
    p = np.pad(image, ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)), mode="edge")
    v = f(np.lib.stride_tricks.sliding_window_view(p, h, axis=0), axis=-1)
    return f(np.lib.stride_tricks.sliding_window_view(v, w, axis=1), axis=-1)


def dilate(image: np.ndarray, h: int, w: int) -> np.ndarray:
    return _morph(image, h, w, np.max)


def erode(image: np.ndarray, h: int, w: int) -> np.ndarray:
    return _morph(image, h, w, np.min)


def close(image: np.ndarray, kernel: int = 2) -> np.ndarray:
    # the second step's window is the first one's mirrored, so nothing moves
    return erode(dilate(image, kernel, kernel)[::-1, ::-1], kernel, kernel)[::-1, ::-1]


def process(image: np.ndarray, width: int = 1000, mode: str = "binary", cutoff: float | None = 150, kernel: int = 1) -> np.ndarray:
    """Trim, resize, close, threshold, close."""
    return close(threshold(close(to_gray(resize(crop_white(image), width)), kernel), mode, cutoff), kernel)


def gradient(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences (x, y) of the lightness after a 5 x 5 mean."""
    light = box_mean(to_gray(image), 5)
    gy, gx = np.gradient(light)
    return gx, gy


def edges(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny's edges: Sobel, thinning along the gradient, and hysteresis."""
    p = np.pad(to_gray(image).astype(float), 1, mode="edge")
    row = p[:, 2:] - p[:, :-2]
    col = p[2:] - p[:-2]
    gx, gy = row[:-2] + 2 * row[1:-1] + row[2:], col[:, :-2] + 2 * col[:, 1:-1] + col[:, 2:]
    size = np.abs(gx) + np.abs(gy)
    s = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: s[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    turn = np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    best = np.zeros((h, w), bool)
    for t, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        best |= (turn == t) & (size >= at(dy, dx)) & (size > at(-dy, -dx))
    weak, strong = best & (size > low), best & (size > high)
    label = components(weak)
    return (label > 0) & np.isin(label, np.unique(label[strong]))


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected parts of a mask, by union-find over neighbouring pairs; 0 is outside."""
    h, w = mask.shape
    index = np.arange(h * w).reshape(h, w)
    pairs = []
    for a, b in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:]), (np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[:-1, 1:], np.s_[1:, :-1])):
        both = mask[a] & mask[b]
        pairs.append((index[a][both], index[b][both]))
    x, y = (np.concatenate(v) for v in zip(*pairs))
    parent = np.arange(h * w)
    while len(x):
        p, q = parent[x], parent[y]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        differ = parent[x] != parent[y]
        x, y = x[differ], y[differ]
    out = np.zeros(h * w, int)
    inside = mask.ravel()
    _, out[inside] = np.unique(parent[inside], return_inverse=True)
    out[inside] += 1
    return out.reshape(h, w)


def hough(mask: np.ndarray, votes: int = 175, steps: int = 180) -> list[tuple[float, float]]:
    """(rho, theta) of the cells with at least so many votes that are peaks among their neighbours."""
    y, x = np.nonzero(mask)
    theta = np.arange(steps) * np.pi / steps
    far = int(np.hypot(*mask.shape)) + 1
    count = np.zeros((2 * far + 1, steps), int)
    for k, t in enumerate(theta):
        count[:, k] = np.bincount(np.rint(x * np.cos(t) + y * np.sin(t)).astype(int) + far, minlength=2 * far + 1)
    peak = (count >= votes) & (count == dilate(count, 3, 3))
    return [(float(r - far), float(theta[k])) for r, k in zip(*np.nonzero(peak))]


def segments(mask: np.ndarray, least: int, gap: int, vertical: bool = False) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of runs of set pixels along rows, or columns, at least so long; gaps up to ``gap`` are bridged."""
    m = mask.T if vertical else mask
    out = []
    for r in np.flatnonzero(m.sum(1) >= least * 0.5):
        on = np.flatnonzero(m[r])
        for run in np.split(on, np.flatnonzero(np.diff(on) > gap + 1) + 1):
            if len(run) and run[-1] - run[0] + 1 >= least:
                a, b = int(run[0]), int(run[-1])
                out.append((int(r), a, int(r), b) if vertical else (a, int(r), b, int(r)))
    return out


def table_lines(image: np.ndarray, vertical: bool = False, share: float = 0.3) -> list[tuple[int, int, int, int]]:
    """Dark rules of a table: what an opening along the direction leaves. Without a vertical one, the image's sides."""
    h, w = image.shape[:2]
    dark = (threshold(image, "binary", None, invert=True) > 0).astype(np.uint8)
    n = max(2, int((h if vertical else w) * share / 4))
    size = (n, 1) if vertical else (1, n)
    rules = dilate(erode(dark, *size), *size) > 0
    found = segments(rules, int((h if vertical else w) * share), n, vertical)
    return found or ([(0, 0, 0, h - 1), (w - 1, 0, w - 1, h - 1)] if vertical else [])


def fill_region(image: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    out = image.copy()
    region = crop(out, x0, y0, x1, y1)
    region[...] = np.median(region.reshape(-1, *region.shape[2:]), axis=0).astype(np.uint8) if region.size else 0
    return out


def paired(image: np.ndarray, y1: int, y2: int, cutoff: int = 100, window: int = 10) -> bool:
    """Whether what lies between two rows is dark at either side of the image."""
    strip = to_gray(image)[min(y1, y2) : max(y1, y2) + 1]
    return bool(strip.size) and bool(np.median(strip[:, :window]) < cutoff or np.median(strip[:, -window:]) < cutoff)


def remove_lines(image: np.ndarray, ys: list[int], half: int = 2) -> np.ndarray:
    """Rows around the given ones are painted with the median of what is above and below them."""
    out = image.copy()
    for y in ys:
        a, b = max(y - half, 0), min(y + half + 1, len(out))
        near = np.concatenate([out[max(a - half, 0) : a], out[b : b + half]])
        if len(near):
            out[a:b] = np.median(near, axis=0).astype(np.uint8)
    return out


def between_lines(image: np.ndarray, ys: list[int], least: int = 10) -> list[tuple[int, np.ndarray]]:
    """(first row, part) of the parts between neighbouring lines that are at least so high."""
    ys = sorted(ys)
    return [(a, image[a:b]) for a, b in zip(ys, ys[1:]) if b - a >= least]


def crop_to_edges(image: np.ndarray, pad: int = 10, low: float = 5, high: float = 200) -> np.ndarray:
    """The box around all edges and some pixels more; an image without edges stays."""
    y, x = np.nonzero(edges(image, low, high))
    return crop(image, int(x.min()) - pad, int(y.min()) - pad, int(x.max()) + pad + 1, int(y.max()) + pad + 1) if len(x) else image


def barcode_strip(image: np.ndarray, cutoff: float = 150, lower: float = 0.25) -> np.ndarray:
    """Black and white, with the bars (parts above half of the height, and narrow) painted white; the lower part."""
    flat = threshold(image, "binary", cutoff)
    label = components(flat == 0)
    h, w = flat.shape
    out = flat.copy()
    for k in range(1, label.max() + 1):
        y, x = np.nonzero(label == k)
        if np.ptp(y) + 1 > h * 0.5 and np.ptp(x) + 1 <= w * 0.5:
            out[y, x] = 255
    return out[int(h * (1 - lower)) :]


def warp(image: np.ndarray, matrix: np.ndarray, x0: int, y0: int, width: int, height: int, mode: str = "black") -> np.ndarray:
    """The image under a homography, over a box of the target: every target pixel is looked up at its source."""
    x, y = np.meshgrid(np.arange(x0, x0 + width, dtype=float), np.arange(y0, y0 + height, dtype=float))
    p = np.linalg.inv(matrix) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    return sample(image, (p[0] / p[2]).reshape(height, width), (p[1] / p[2]).reshape(height, width), mode)


def flatten_between(image: np.ndarray, ys: np.ndarray, curves: np.ndarray, mode: str = "clamp") -> np.ndarray:
    """Rows bent along curves made straight: curves[k, x] is the height in column x of what is to lie at ys[k]; between curves the shift
    is interpolated, beyond the outer ones it is theirs."""
    h, w = image.shape[:2]
    rows = np.arange(h, dtype=float)
    shift = np.stack([np.interp(rows, ys, curves[:, c] - ys) for c in range(w)], axis=1)
    return sample(image, np.broadcast_to(np.arange(w, dtype=float), (h, w)), rows[:, None] + shift, mode)
