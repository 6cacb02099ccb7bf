"""Scalar functions as Column expressions: sizes, durations, versions, schedules, progress, media metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def count_digits(x: Column) -> Column:
    """Length of the decimal text, sign included."""
    return F.length(x.cast("string"))


def bytes_human(size: Column, precision: int = 2) -> Column:
    """'1024.00 B', '1.00 KB' from 1025 on, up to PB: one unit up while above 1024."""
    size = size.cast("double")
    out = F.lit(None).cast("string")
    for i in range(len(UNITS) - 1, -1, -1):
        shown = F.format_string(f"%.{precision}f {UNITS[i]}", size / float(1024**i))
        # the size at unit i is at most 1024: every unit below it was above
        out = shown if i == len(UNITS) - 1 else F.when(size / float(1024**i) <= 1024, shown).otherwise(out)
    return out


def bytes_human_exact(size: Column) -> Column:
    """'512 B' below 1024, then two decimals from KB to TB; 1024 is '1.00 KB'."""
    out = F.format_string("%.2f TB", size / float(1024**4))
    for i in (3, 2, 1):
        out = F.when(size < 1024 ** (i + 1), F.format_string(f"%.2f {UNITS[i]}", size / float(1024**i))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def seconds_human(seconds: Column) -> Column:
    """hh:mm:ss.mmm without the leading units that are zero; '  7ms' below a second."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    ms = F.floor((seconds - whole) * 1000).cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.when(h > 99, h.cast("string")).otherwise(two(h))
    text = F.when(h > 0, F.concat_ws(":", hours, two(m), two(s))).when(m > 0, F.concat_ws(":", two(m), two(s))).when(s > 0, two(s))
    return F.when(text.isNotNull(), F.concat(text, F.lit("."), F.lpad(ms.cast("string"), 3, "0"))).otherwise(F.concat(F.lpad(ms.cast("string"), 3, " "), F.lit("ms")))


def version_parts(text: Column) -> list[Column]:
    """major, minor, patch as ints, null where they are missing; one leading v is skipped."""
    parts = F.split(F.regexp_replace(text, "^v", ""), r"\.")
    number = lambda i: F.when(F.size(parts) > i, F.element_at(F.split(F.ltrim(F.get(parts, F.lit(i))), r"\s+"), 1).cast("int"))
    return [number(i) for i in range(3)]


def version_compare(a: Column, b: Column) -> dict[str, Column]:
    """eq, gt, lt. A minor or patch that is missing or 0 matches any, so the order is not total: don't sort by it."""
    (a0, a1, a2), (b0, b1, b2) = version_parts(a), version_parts(b)
    both = lambda x, y: F.coalesce((x != 0) & (y != 0), F.lit(False))
    eq = (a0 == b0) & ~(both(a1, b1) & (a1 != b1)) & ~(both(a2, b2) & (a2 != b2))

    def above(x, y):
        (x0, x1, x2), (y0, y1, y2) = x, y
        patch = both(x2, y2) & (x2 > y2)
        minor = F.when(both(x1, y1) & (x1 != y1), x1 > y1).otherwise(patch)
        return F.when(x0 != y0, x0 > y0).otherwise(minor)

    return {"eq": F.coalesce(eq, F.lit(False)), "gt": F.coalesce(above((a0, a1, a2), (b0, b1, b2)), F.lit(False)), "lt": F.coalesce(above((b0, b1, b2), (a0, a1, a2)), F.lit(False))}


def warmup_constant(epoch: Column, lr: float, warmup: int) -> Column:
    return F.when(epoch < warmup, F.lit(lr) * (epoch + 1) / (warmup + 1)).otherwise(F.lit(lr))


def warmup_cosine(epoch: Column, lr: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine that starts again every total - warmup epochs."""
    span = total - warmup
    wave = F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * F.pmod(epoch - warmup, F.lit(span)) / span)) * lr
    return F.when(epoch < warmup, F.lit(lr) * (epoch + 1) / (warmup + 1)).otherwise(wave)


def remaining(elapsed: Column, progress: Column) -> Column:
    return elapsed * (1 / progress - 1)


def progress_bar(progress: Column, size: int, blocks: str = " ▏▎▍▌▋▊▉█") -> Column:
    """Full blocks, then one in eighths, padded with spaces."""
    full = F.floor(progress * size).cast("int")
    part = F.floor((progress * size - full) * (len(blocks) - 1)).cast("int")
    tail = F.when((part > 0) & (full < size), F.substring(F.lit(blocks), part + 1, F.lit(1))).otherwise("")
    return F.rpad(F.concat(F.repeat(F.lit(blocks[-1]), full), tail), size, " ")


def normalized(v: Column, mean: float | list[float], std: float | list[float]) -> Column:
    """(x - mean) / std in double, for all values or value by value."""
    if isinstance(mean, list):
        pair = F.arrays_zip(F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, std)).alias("s"))
        return F.zip_with(v, pair, lambda x, p: (x.cast("double") - p["m"]) / p["s"])
    return F.transform(v, lambda x: (x.cast("double") - mean) / std)


def repeat_channels(v: Column, n: int = 3) -> Column:
    """Each value n times in a row: gray to n channels, channels last."""
    return F.flatten(F.transform(v, lambda x: F.array_repeat(x, n)))


# media metadata: an augmentation is a projection of a row's metadata


def center_crop(width: Column, height: Column, ratio: float) -> dict[str, Column]:
    cw, ch = F.floor(width * ratio), F.floor(height * ratio)
    return {"crop_w": cw, "crop_h": ch, "crop_x": F.floor((width - cw) / 2), "crop_y": F.floor((height - ch) / 2), "width": width, "height": height}


def random_crop(width: Column, height: Column, ratio: float, ux: Column, uy: Column) -> dict[str, Column]:
    """ux, uy: uniform in [0, 1)."""
    cw, ch = F.floor(width * ratio), F.floor(height * ratio)
    return {"crop_w": cw, "crop_h": ch, "crop_x": F.floor(ux * (width - cw + 1)), "crop_y": F.floor(uy * (height - ch + 1)), "width": width, "height": height}


def resized(width: int, height: int) -> dict[str, Column]:
    return {"width": F.lit(width).cast("long"), "height": F.lit(height).cast("long")}


def trimmed(duration: Column, rate: Column, start: float = 0.0, end: float | None = None) -> dict[str, Column]:
    """Duration and number of frames (or samples) from start to end (the whole duration's end)."""
    length = (duration if end is None else F.lit(end)) - start
    return {"duration": length, "count": F.floor(length * rate).cast("long")}


def resampled(duration: Column, rate: int) -> dict[str, Column]:
    return {"sample_rate": F.lit(rate).cast("long"), "nb_samples": F.floor(duration * rate).cast("long")}


def pitched(duration: Column, rate: Column, semitones: Column) -> dict[str, Column]:
    new = F.floor(rate * F.pow(F.lit(2.0), semitones / 12)).cast("long")
    return {"sample_rate": new, "nb_samples": F.floor(duration * new).cast("long")}


def temporal_crop(rate: Column, n: int) -> dict[str, Column]:
    return {"nb_frames": F.lit(n).cast("long"), "duration": n / rate}


def subframes(total: Column, rate: Column, n: int) -> dict[str, Column]:
    """Every max(total // n, 1)-th frame, n at most."""
    step = F.greatest(F.floor(total / n), F.lit(1))
    frames = F.slice(F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1, step)).otherwise(F.array().cast("array<bigint>")), 1, n)
    kept = F.least(F.lit(n).cast("long"), total)
    return {"frames": frames, "nb_frames": kept, "frame_rate": rate * (kept / total)}


def count_fallback(stored: Column, duration: Column, rate: Column, audio: bool) -> Column:
    """The stored count, else duration * rate: cut off for audio, rounded half to even for video."""
    return F.coalesce(stored, (F.floor(duration * rate) if audio else F.rint(duration * rate)).cast("long"))


def valid_slice(start: Column, stop: Column, duration: Column) -> Column:
    return (start >= 0) & (stop <= duration) & (start < stop)


def requiring(step, *names: str):
    """The step, which raises ValueError where the metadata lack one of the names."""

    def checked(meta: dict[str, Column]) -> dict[str, Column]:
        lost = [n for n in names if n not in meta]
        if lost:
            raise ValueError(f"{getattr(step, '__name__', 'the step')} needs {', '.join(lost)} in the metadata")
        return step(meta)

    return checked


def composed(steps: list, meta: dict[str, Column]) -> dict[str, Column]:
    """Steps from a metadata dict to its changes, one after the other."""
    return reduce(lambda m, step: m | step(m), steps, meta)


def content_hash(c: Column, kind: str = "sha256") -> Column:
    if kind not in ("sha256", "sha1", "md5"):
        raise ValueError(f"unknown hash {kind!r}")
    return F.sha2(c, 256) if kind == "sha256" else F.sha1(c) if kind == "sha1" else F.md5(c)
