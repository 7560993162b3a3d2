"""Numeric kernels on small images and one-dimensional mixtures; numpy inside Arrow batches."""

from __future__ import annotations

import math

import numpy as np


def binarize(gray: np.ndarray, block: int = 11, offset: float = 2) -> np.ndarray:
    """Ink (True) where a pixel is darker than the mean around it by more than ``offset``."""
    r = block // 2
    p = np.pad(gray.astype(float), r + 1, mode="edge").cumsum(0).cumsum(1)
    h, w = gray.shape
    total = p[block : block + h, block : block + w] - p[:h, block : block + w] - p[block : block + h, :w] + p[:h, :w]
    return gray < total / block**2 - offset


def ink_profile(ink: np.ndarray, axis: int = 1) -> np.ndarray:
    return ink.sum(axis)


def transitions(ink: np.ndarray) -> np.ndarray:
    """Changes along each row, then along each column."""
    x = ink.astype(np.int8)
    return np.concatenate([np.abs(np.diff(x, axis=1)).sum(1), np.abs(np.diff(x, axis=0)).sum(0)])


def sobel_histogram(image: np.ndarray, cells: int = 4, directions: int = 12) -> np.ndarray:
    """How many pixels of at least mean gradient point each way, in cells * cells regions.

    A pixel counts for the two directions that its angle lies between, for one if it
    points there exactly.  At the edges the image is mirrored.
    """
    p = np.pad(image.astype(float), 1, mode="reflect")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx))
    y, x = np.indices(image.shape)
    cell = y * cells // image.shape[0] * cells + x * cells // image.shape[1]
    strong, wide = size >= size.mean(), 360.0 / directions
    low = np.floor(angle / wide).astype(int) % directions
    between = np.fmod(angle, wide) != 0
    bins = np.concatenate([(cell * directions + low)[strong], (cell * directions + (low + 1) % directions)[strong & between]])
    return np.bincount(bins, minlength=cells * cells * directions)


def feature_vector(image: np.ndarray, mean: np.ndarray | None = None, dev: np.ndarray | None = None) -> np.ndarray:
    """Zernike moments, gradient directions and transitions in a row; standardised if means and deviations are given."""
    out = np.concatenate([zernike(image), sobel_histogram(image), transitions(image > 0)]).astype(float)
    return out if mean is None else (out - mean) / dev


def region_contrast(gray: np.ndarray, x: int, y: int, size: int = 50) -> dict[str, float]:
    """Mean, deviation, least, greatest and span of the pixels around a place, as far as the image goes."""
    r = gray[max(0, y - size // 2) : y + size // 2, max(0, x - size // 2) : x + size // 2].astype(float)
    if not r.size:
        return dict.fromkeys(("mean", "std", "min", "max", "contrast"), float("nan"))
    return {"mean": float(r.mean()), "std": float(r.std()), "min": float(r.min()), "max": float(r.max()), "contrast": float(r.max() - r.min())}


def padded(image: np.ndarray, by: int = 3, white: int = 1) -> np.ndarray:
    return np.pad(image, by, constant_values=white)


def inverted(image: np.ndarray) -> np.ndarray:
    """Ink and ground changed for each other, in images of 0 and 1 or of 0 and 255; the result is of 0 and 1."""
    top = 255 if image.max(initial=0) == 255 else 1
    return 1 - image / top


def cut_lines(gray: np.ndarray, tops: np.ndarray, inflate: int = 1, share: float = 0.9995) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rows of the lines, their baselines, the line of each top or -1) of a page with white (its greatest value) between lines.

    Ink is grown by ``inflate`` pixels first, so that vowels stay with their line.  A line
    begins a row above where the sum falls below ``share`` of the greatest one; its
    baseline is its darkest row.  What stands above the first line is of none; a page
    without breaks is one line.
    """
    page = gray.astype(float)
    for _ in range(inflate):
        p = np.pad(page, 1, mode="edge")
        page = np.min([p[i : i + page.shape[0], j : j + page.shape[1]] for i in range(3) for j in range(3)], axis=0)
    sums = page.sum(1)
    limit = sums.max(initial=0) * share
    starts = np.flatnonzero((sums < limit) & (np.roll(sums, 1) >= limit)) - 1
    if not len(starts):
        return starts, np.zeros(0, int), np.zeros(len(tops), int)
    edges = np.append(np.maximum(starts, 0), len(sums))
    baselines = np.array([a + int(sums[a:b].argmin()) for a, b in zip(edges[:-1], edges[1:])])
    return starts, baselines, np.searchsorted(starts - 1, tops, "right") - 1


def too_tall(heights: np.ndarray) -> np.ndarray:
    """Which heights exceed the mean of the others by over two of their deviations."""
    others = [np.delete(heights, i) for i in range(len(heights))]
    return np.array([bool(len(o)) and h > o.mean() + 2 * o.std() for h, o in zip(heights, others)], bool)


def count_lines(profile: np.ndarray, sigma: float = 25.0, least: float = 0.01) -> int:
    """Lines of ink in a profile of sums of white: minima of the smoothed profile that hold at least ``least`` of all ink."""
    ink = profile.max(initial=0) - profile.astype(float)
    if not ink.sum():
        return 0
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(np.pad(ink, reach, mode="symmetric"), kernel / kernel.sum(), mode="valid")
    tops = np.flatnonzero((smooth[1:-1] > smooth[:-2]) & (smooth[1:-1] >= smooth[2:])) + 1
    edges = np.concatenate([[0], (tops[1:] + tops[:-1]) // 2, [len(ink)]]) if len(tops) else np.array([0, len(ink)])
    return int(sum(ink[a:b].sum() >= least * ink.sum() for a, b in zip(edges[:-1], edges[1:])))


def normalised(image: np.ndarray, size: int = 32, white: int = 1) -> np.ndarray:
    """A character's image (ink 0, white 1) as size * size pixels: the long side fills it, the short one by the root of their ratio, in the middle.

    Pixels are means of the area they cover, cut at one half.
    """
    h, w = image.shape
    share = np.sqrt(min(h, w) / max(h, w))
    nh, nw = (size, max(1, round(size * share))) if h >= w else (max(1, round(size * share)), size)

    def weights(n: int, m: int) -> np.ndarray:
        a, b = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
        covered = np.minimum(b, np.arange(n) + 1) - np.maximum(a, np.arange(n))
        return np.maximum(covered, 0) / (n / m)

    small = weights(h, nh) @ image.astype(float) @ weights(w, nw).T >= 0.5
    out = np.full((size, size), white, np.uint8)
    top, left = -(-(size - nh) // 2), -(-(size - nw) // 2)
    out[top : top + nh, left : left + nw] = small
    return out


def mixture(x: np.ndarray, times: np.ndarray | None = None, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of two Gaussians, started at the least and greatest value; each value counts ``times``."""
    x = np.asarray(x, float)
    times = np.ones(len(x)) if times is None else np.asarray(times, float)
    spread = np.sqrt(np.average((x - np.average(x, weights=times)) ** 2, weights=times))
    mean, dev, weight = np.array([x.min(), x.max()]), np.full(2, spread + 1e-6), np.full(2, 0.5)
    for _ in range(rounds):
        log = np.log(weight) - np.log(dev) - 0.5 * ((x[:, None] - mean) / dev) ** 2
        share = np.exp(log - log.max(1, keepdims=True))
        share *= (times / share.sum(1))[:, None]
        n = share.sum(0) + 1e-12
        weight, mean = n / n.sum(), (share * x[:, None]).sum(0) / n
        dev = np.sqrt((share * (x[:, None] - mean) ** 2).sum(0) / n) + 1e-6
    return weight, mean, dev


def kmeans_1d(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Centres started at quantiles."""
    c = np.quantile(x, (np.arange(k) + 0.5) / k)
    for _ in range(rounds):
        own = np.abs(x[:, None] - c).argmin(1)
        after = np.array([x[own == i].mean() if (own == i).any() else c[i] for i in range(k)])
        if np.allclose(after, c):
            break
        c = after
    return np.sort(c)


def components(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected pieces of ink (8 neighbours): their labels from 1 in reading order, and a box (x, y, w, h, pixels) for each."""
    h, w = ink.shape
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    root = np.arange(len(row))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    of_row = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = of_row[y - 1], of_row[y]
        while i < of_row[y] and j < of_row[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    _, own = np.unique([find(i) for i in range(len(row))], return_inverse=True) if len(row) else (None, np.zeros(0, int))
    labels, boxes = np.zeros((h, w), np.int32), []
    for y, a, b, k in zip(row, start, end, own):
        labels[y, a:b] = k + 1
    for k in range(own.max(initial=-1) + 1):
        m = own == k
        x, y = start[m].min(), row[m].min()
        boxes.append((x, y, end[m].max() - x, row[m].max() - y + 1, (end[m] - start[m]).sum()))
    return labels, np.array(boxes, np.int64).reshape(-1, 5)


def zernike(image: np.ndarray, degree: int = 17) -> np.ndarray:
    """Magnitudes of the Zernike moments up to ``degree`` over the disc around the image's centre; turning the image keeps them."""
    h, w = image.shape
    y, x = np.indices(image.shape)
    x, y = (2 * x + 1 - w) / np.hypot(w, h), (2 * y + 1 - h) / np.hypot(w, h)
    r, turn, mass = np.hypot(x, y).ravel(), np.arctan2(y, x).ravel(), image.astype(float).ravel()
    powers = r[None] ** np.arange(degree + 1)[:, None]
    out = []
    for n in range(degree + 1):
        for m in range(n % 2, n + 1, 2):
            radial = sum((-1) ** k * math.comb(n - k, k) * math.comb(n - 2 * k, (n - m) // 2 - k) * powers[n - 2 * k] for k in range((n - m) // 2 + 1))
            out.append((n + 1) / np.pi * abs((mass * radial * np.exp(-1j * m * turn)).sum()) * 4 / (w * w + h * h))
    return np.array(out)


def skew(ink: np.ndarray, most: float = 10, step: float = 0.25) -> float:
    """The angle in degrees, clockwise on the page, at which lines of ink gather best in a Hough accumulator."""
    y, x = np.nonzero(ink)
    angles = np.arange(-most, most + step / 2, step)
    angles = angles[np.argsort(np.abs(angles), kind="stable")]  # of equal ones the least
    best = [float((np.unique(np.round(y * np.cos(a) - x * np.sin(a)), return_counts=True)[1].astype(float) ** 2).sum()) for a in np.radians(angles)]
    return float(angles[int(np.argmax(best))]) if len(y) else 0.0


def otsu(gray: np.ndarray) -> int:
    """The level (0 to 255) that parts the pixels into two groups that vary least inside; ink is at or below it."""
    n = np.bincount(gray.astype(np.uint8).ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.nan_to_num(apart, nan=-1.0).argmax())


def character_size(gray: np.ndarray, unknown: float = 16.0) -> float:
    """The greater of the median width and height of connected pieces that are no specks and no large regions."""
    boxes = components(gray <= otsu(gray))[1] if gray.size and gray.min() < gray.max() else np.zeros((0, 5), int)
    h, w = gray.shape
    fit = boxes[(boxes[:, 2] >= 3) & (boxes[:, 2] <= 0.3 * w) & (boxes[:, 3] >= 3) & (boxes[:, 3] <= 0.3 * h)]
    return float(max(np.median(fit[:, 2]), np.median(fit[:, 3]))) if len(fit) else unknown


def enlarged(gray: np.ndarray, least: float = 12, small: float = 10, page: tuple[int, int] = (100, 200), bounds: tuple[float, float] = (1.2, 1.5)) -> np.ndarray:
    """The image, made larger by linear interpolation if its characters or itself are very small; never beyond ``bounds``."""
    size = character_size(gray)
    if size >= small and gray.shape[0] >= page[0] and gray.shape[1] >= page[1]:
        return gray
    by = min(max(bounds[0], least / size), bounds[1])
    h, w = int(gray.shape[0] * by), int(gray.shape[1] * by)

    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = places(gray.shape[0], h), places(gray.shape[1], w)
    g = gray.astype(float)
    rows = g[y0] * (1 - fy[:, None]) + g[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def without_specks(ink: np.ndarray, width: int = 5, height: int = 5) -> np.ndarray:
    """Ink without connected pieces of at most ``width`` times ``height`` pixels."""
    labels, boxes = components(ink)
    specks = np.flatnonzero((boxes[:, 2] <= width) & (boxes[:, 3] <= height)) + 1
    return ink & ~np.isin(labels, specks)


def decode_pgm(raw: bytes) -> np.ndarray:
    """A grey image from binary PGM; pixels 0 to 255."""
    import re

    head = re.match(rb"P5(?:\s+#[^\n]*\n|\s)+(\d+)\s+(\d+)\s+(\d+)\s", raw)
    if not head:
        raise ValueError("no binary PGM image")
    w, h, top = (int(g) for g in head.groups())
    kind = ">u2" if top > 255 else "u1"
    pixels = np.frombuffer(raw, kind, w * h, head.end()).reshape(h, w)
    return (pixels.astype(float) * 255 / top).round().astype(np.uint8)
