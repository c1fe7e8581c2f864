"""What hints and moods say about a voice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taleweave.functions.markup import trim

# Vocabularies of gender, age and mood, and the reading parameters of moods.
FEMALE_WORDS = ("female", "woman", "lady", "nữ", "cô", "chị", "gái", "bà")
MALE_WORDS = ("male", "man", "nam", "ông", "anh", "trai", "lão")
CLOSED_HEADS = ("adult male", "adult female", "boy", "girl", "elderly male", "elderly female")
TAG_FEMALE = ("female", "nữ", "cô", "gái", "bà", "lady")
TAG_MALE = ("male", "nam", "ông", "lão", "anh", "trai", "man")
MOODS = {
    "neutral": (0.80, 0.15), "calm": (0.72, 0.12), "reflective": (0.75, 0.18), "grand": (0.85, 0.20), "sarcastic": (0.85, 0.12), "ironic": (0.85, 0.12),
    "amused": (0.90, 0.12), "excited": (0.92, 0.10), "smug": (0.88, 0.12), "happy": (0.90, 0.10), "sad": (0.85, 0.22), "angry": (0.90, 0.18),
    "cold": (0.70, 0.15), "stern": (0.72, 0.18), "urgent": (0.92, 0.08), "surprised": (0.90, 0.10), "shocked": (0.90, 0.20), "gossipy": (0.88, 0.10),
}
CLUSTERS = {
    "neutral": ("flat", "monotone", "expository", "narrative", "matter-of-fact", "mildly", "observant", "descriptive", "indifferent", "awkward", "pragmatic", "casual"),
    "calm": ("serene", "unconcerned", "reflective"), "amused": ("ironic", "sarcastic"), "sad": ("helpless", "resigned", "subdued", "pouting"),
    "excited": ("amazed", "earnest", "playful", "pleading", "happy", "warm", "grand", "admiring"), "smug": ("satisfied", "self-satisfied"),
    "urgent": ("hasty",), "cold": ("aloof", "arrogant", "stern", "strict"), "angry": ("annoyed",),
}
DEFAULT_TAKE = (0.80, 0.15)


def hint_gender(hint: Column) -> Column:
    """Gender that the head of a hint announces; null if none. Female first, as it holds the other word."""
    head = F.lower(F.regexp_extract(hint, "^([^,:;–-]*)", 1))
    return F.when(head.rlike("female|girl"), "female").when(head.rlike("male|boy"), "male")


def letter_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _any(words: Column, vocabulary) -> Column:
    return F.exists(words, lambda w: w.isin(*vocabulary))


def voice_hint(hint: Column) -> Column:
    """A closed head as it is; else the head that the words of the hint give, before the hint."""
    t, words = trim(hint), letter_words(hint)
    head = F.lower(F.trim(F.regexp_extract(t, "^([^,:–-]*)", 1)))
    old, female, male = _any(words, ("elderly", "old")), _any(words, FEMALE_WORDS), _any(words, MALE_WORDS)
    made = (
        F.when(old & female, "elderly female").when(old, "elderly male").when(_any(words, ("girl",)), "girl").when(_any(words, ("boy",)), "boy")
        .when(female, "adult female").when(male, "adult male").otherwise("unknown")
    )
    return F.when(head.isin(*CLOSED_HEADS), head).when(t == "", made).otherwise(F.concat(made, F.lit(": "), t))


def hint_tags(hint: Column) -> Column:
    """Age, gender and strength tags of a hint's words, in this order."""
    words = letter_words(hint)
    has = lambda *v: _any(words, v)
    girl, boy = has("girl"), has("boy")
    age = F.when(girl | boy | (~has("elderly", "old") & has("young")), "young").when(has("elderly", "old"), "old")
    gender = F.when(girl, "female").when(boy, "male").when(_any(words, TAG_FEMALE), "female").when(_any(words, TAG_MALE), "male")
    strength = F.when(has("strong"), "strong").when(has("weak"), "weak")
    return F.array_compact(F.array(age, gender, strength))


def lexicon_gender(names: Column, female: list[str], male: list[str]) -> Column:
    """Gender whose term has all its words among the words of names (an array); female first."""
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hay = split(F.array_join(names, " "))
    finds = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.size(F.array_except(split(t), hay)) == 0)
    return F.when(finds(female), "female").when(finds(male), "male")


def mood_cluster(mood: Column) -> Column:
    """First word of a mood, on the small vocabulary; nothing means neutral."""
    first = F.regexp_replace(F.lower(F.regexp_extract(mood, r"^[ \t\n\r\f\x0B]*([^ \t\n\r\f\x0B]*)", 1)), r"^[,.]+|[,.]+\z", "")
    out = F.when(first == "", "neutral")
    for cluster, words in CLUSTERS.items():
        out = out.when(first.isin(*words), cluster)
    return out.otherwise(first)


def take_parameters(cluster: Column) -> tuple[Column, Column]:
    """Temperature and silence of a mood's reading."""
    temperature, silence = F.lit(DEFAULT_TAKE[0]), F.lit(DEFAULT_TAKE[1])
    for mood, (t, s) in MOODS.items():
        temperature, silence = F.when(cluster == mood, t).otherwise(temperature), F.when(cluster == mood, s).otherwise(silence)
    return temperature, silence
