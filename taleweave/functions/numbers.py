"""Times, frames, easing, vectors and keys as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ticks of one second; frames of a chunk per phoneme, spare, of one word and per further syllable.
TICKS_PER_SECOND = 254_016_000_000
PER_PHONEME, SPARE, ONE_WORD, PER_SYLLABLE, SYLLABLES, WORD_PHONEMES = 2.0, 24, 13, 5, 4, 24
VOWELS = "aeiouyæɐɑɒɔəɘɛɜɤɯɵøœʉʊʌɪɨ"


def human(seconds: Column) -> Column:
    """3h 12m, 4m 05s or 48s."""
    s = seconds
    part = lambda a, b, u, v: F.format_string(f"%d{u} %02d{v}", a.cast("long"), b.cast("long"))
    hours, minutes = F.floor(s / 3600), F.floor(s / 60)
    return F.when(s >= 3600, part(hours, F.floor(s % 3600 / 60), "h", "m")).when(s >= 60, part(minutes, s % 60, "m", "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))


def timestamp(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds, of whole milliseconds not below zero."""
    t = F.greatest(ms, F.lit(0))
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(t / 3600000), F.floor(t % 3600000 / 60000), F.floor(t % 60000 / 1000), t % 1000)


def ticks(seconds: Column) -> Column:
    return F.round(seconds * TICKS_PER_SECOND).cast("long")


def frame_ticks(seconds: Column, fps: Column) -> Column:
    """On the frame grid: whole frames times the ticks of one."""
    return F.round(seconds * fps).cast("long") * F.round(F.lit(float(TICKS_PER_SECOND)) / F.greatest(fps, F.lit(1.0))).cast("long")


def loop_copies(window: Column, clip: Column, xfade: Column) -> Column:
    """Copies of a clip that fill a window with a crossfade of up to a quarter clip at each seam; null if one is enough."""
    x = F.least(F.greatest(xfade, F.lit(0.0)), clip / 4)
    copies = F.greatest(F.ceil((window - x) / F.greatest(clip - x, F.lit(1e-6))), F.lit(2)).cast("int")
    return F.when((clip > 0) & (window > clip), copies)


def gain(t: Column, base: float, lift: float, ramp: float, start: float, pauses: list[tuple[float, float]]) -> Column:
    """Level at t: lifted through pauses, with ramps at both ends."""
    out, d = F.lit(base), lift - base
    clip = lambda at: F.least(F.greatest((t - F.lit(max(at - start, 0.0))) / F.lit(ramp), F.lit(0.0)), F.lit(1.0))
    for a, b in pauses if abs(d) > 1e-9 and ramp > 0 else ():
        out = out + F.lit(d) * clip(a) - F.lit(d) * clip(b)
    return out


def ease(name: Column, u: Column) -> Column:
    """Pace of one segment, u in 0 .. 1."""
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
    v, half = 1 - u, F.lit(math.pi / 2)
    curves = {
        "in": u * u, "out": 1 - v * v, "in-out": F.when(u < 0.5, 2 * u * u).otherwise(1 - 2 * v * v), "in-cubic": u * u * u, "out-cubic": 1 - v * v * v,
        "in-out-cubic": F.when(u < 0.5, 4 * u * u * u).otherwise(1 - 4 * v * v * v), "in-sin": 1 - F.cos(u * half), "out-sin": F.sin(u * half),
        "in-out-sin": (1 - F.cos(F.lit(math.pi) * u)) / 2,
    }
    out = u
    for k, value in curves.items():
        out = F.when(name == k, value).otherwise(out)
    return out


def moved(t: Column, start: float, to: float, dur: float, repeat: int, pingpong: bool, curve: str) -> Column:
    """Value of a property t seconds in: `repeat` passes of `dur` (0: without end), every second one backwards if asked."""
    at = t / F.lit(dur)
    k = F.floor(at)
    back = (k % 2 == 1) & F.lit(pingpong)
    a, b = F.when(back, to).otherwise(start), F.when(back, start).otherwise(to)
    moving = a + (b - a) * ease(F.lit(curve), at - k)
    end = start if pingpong and repeat % 2 == 0 else to
    return moving if repeat == 0 else F.when(at < repeat, moving).otherwise(F.lit(end))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x).cast("double")))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def penalise(logits: Column, seen: Column, penalty: float) -> Column:
    hit = lambda i: F.array_contains(seen, i)
    return F.transform(logits, lambda x, i: F.when(hit(i), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x))


def quantise(x: Column, levels: int) -> Column:
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(8.0)) * levels).cast("int")


def take_key(engine: Column, voice: Column, text: Column, temperature: Column, silence: Column) -> Column:
    """First 16 hex digits of a digest of exactly what decides how a take sounds."""
    numbers = F.format_string("%.4f|%.4f", temperature, silence)
    return F.substring(F.sha2(F.concat_ws("\0", F.lit("take-v1"), engine, voice, numbers, text), 256), 1, 16)


def frame_cap(length: Column, syllables: Column) -> Column:
    """Frames a chunk may take by its phonemes; a few syllables of plausible length are held tighter."""
    cap = SPARE + F.ceil(length * PER_PHONEME)
    tight = (syllables <= SYLLABLES) & (length <= WORD_PHONEMES * syllables)
    return F.when(tight, F.least(cap, ONE_WORD + PER_SYLLABLE * (syllables - 1))).otherwise(cap).cast("int")
