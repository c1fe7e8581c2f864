"""Words, sentences, names and marks: column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taleweave.functions.markup import SPACE, trim

# Marker words of thoughts, honorific suffixes, heads of descriptions, forms that are no one's alias, speech
# verbs, letter folds.
THOUGHT_MARKERS = (
    "i", "i'd", "i'll", "i'm", "i've", "my", "me", "mine", "myself", "we", "us", "our", "ours", "let's",
    "you", "your", "yours", "yourself", "yourselves", "tôi", "tao", "tớ",
)
FIRST_PERSON = ("i", "i'd", "i'll", "i'm", "i've", "my", "me", "mine", "myself")
TITLE_SUFFIXES = (
    "lão tổ", "tiền bối", "đại nhân", "công tử", "tiểu thư", "thiếu gia", "trưởng lão", "sư phụ", "sư huynh", "sư tỷ",
    "sư đệ", "sư muội", "đạo hữu",
)
DESCRIPTIVE_HEADS = (
    "người", "kẻ", "tên", "gã", "nữ tử", "nam tử", "cô gái", "thiếu nữ", "thiếu niên", "lão giả", "lão nhân", "lão đầu",
    "thanh niên", "nam nhân", "nữ nhân", "hán tử", "đại hán",
)
ALIAS_STOP = (
    "hắn", "nàng", "ta", "ngươi", "y", "huynh", "đệ", "tỷ", "muội", "phàm nhân", "con", "người", "tên", "tiểu", "lão", "tiểu tử",
    "narrator", "người dẫn chuyện", "nữ tử", "nam tử", "cô gái", "thiếu nữ", "thiếu niên", "nam hài", "cháu gái", "tiểu thư",
    "công tử", "tiểu nam hài", "nữ nhân này", "tiền bối", "sư phụ", "sư thúc", "sư tôn", "tông chủ", "hội trưởng", "thánh nữ",
    "phu nhân", "lão gia", "các hạ", "đại vương", "vương", "tiên nữ", "thuộc hạ", "quản gia", "lão ca", "lão già", "lão giả",
    "lão đầu", "đồ nhi", "đệ tử", "sư điệt", "ca ca", "đại ca", "hiền đệ", "hiền huynh", "lão hữu", "bản tôn", "bổn hoàng",
    "vị kia", "ông ta", "một thanh niên", "một phàm nhân", "phàm nhân này", "bọn họ", "thiếu niên này", "vị thiếu niên này",
    "hai vị cô nương", "hai cô gái", "chó", "tiểu cẩu", "chú chó", "con chó", "cẩu nhi", "quạ đen", "con rết",
)
SPEECH_VERBS = (
    "nói", "hỏi", "đáp", "kêu", "rằng", "quát", "thốt", "hét", "gào", "than", "khấn", "dặn", "bảo", "thưa", "đọc",
    "trả lời", "lên tiếng", "tiếp lời", "ngắt lời", "thì thầm", "lẩm bẩm", "cười nói",
)
FOLDS = {
    "a": "àáạảãâầấậẩẫăằắặẳẵ", "e": "èéẹẻẽêềếệểễ", "i": "ìíịỉĩ", "o": "òóọỏõôồốộổỗơờớợởỡ", "u": "ùúụủũưừứựửữ", "y": "ỳýỵỷỹ",
    "d": "đ",
}
FOLD_FROM = "".join(v + v.upper() for v in FOLDS.values()) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD_TO = "".join(k * (2 * len(v)) for k, v in FOLDS.items()) + "abcdefghijklmnopqrstuvwxyz"
WORD_EDGE = r"[^\p{L}\p{N}'’]"


def fold(text: Column) -> Column:
    """Vietnamese letters to plain ones; A-Z lower-cased, other letters as they are."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def letter_words(text: Column) -> Column:
    """Distinct lower-cased runs of letters, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))


def speakable(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def headline(text: Column) -> Column:
    return text.rlike(rf"^{SPACE}*(?:Chương|Chapter){SPACE}*[0-9]")


def quoted_term(span: Column) -> Column:
    """At most 24 characters and four words on one line, with no end mark: a term in quotes, not speech."""
    t = trim(span)
    return (t != "") & ~t.rlike(r"[\n.!?…]") & (F.length(t) <= 24) & (F.size(F.split(t, rf"{SPACE}+")) <= 4)


def _folded_words(text: Column) -> Column:
    bare = lambda w: F.replace(F.lower(F.regexp_replace(w, rf"^{WORD_EDGE}+|{WORD_EDGE}+\z", "")), F.lit("’"), F.lit("'"))
    return F.transform(F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != ""), bare)


def first_person(text: Column) -> Column:
    return F.exists(_folded_words(text), lambda w: w.isin(*FIRST_PERSON))


def thought(sentence: Column) -> Column:
    """A marker word before the word after the second comma."""
    start = F.regexp_extract(sentence, rf"^((?:[^,]*,){{0,1}}[^,]*(?:,[^ \t\n\r\f\x0B]*)?)", 1)
    return F.exists(_folded_words(start), lambda w: w.isin(*THOUGHT_MARKERS))


def canon_key(name: Column) -> Column:
    """Squeezed, without a trailing bracket, lower-cased, without honorifics at the end unless nothing else is left. The
    patterns run only where white space or the last letters call for them, since most names need neither."""
    odd = F.contains(name, F.lit("  "))
    for c in "\t\n\r\f\x0B":
        odd = odd | F.contains(name, F.lit(c))
    s = F.trim(F.when(odd, F.regexp_replace(name, rf"{SPACE}+", " ")).otherwise(name))
    bracket = F.endswith(s, F.lit(")")) & F.contains(s, F.lit("("))
    s = F.when(bracket, F.left(s, F.length(s) - F.length(F.substring_index(s, "(", -1)) - 1)).otherwise(s)
    low = F.trim(F.lower(F.trim(s)))
    titles, heads = "|".join(TITLE_SUFFIXES), "".join(dict.fromkeys(t[0] for t in TITLE_SUFFIXES))
    bare = F.trim(F.regexp_replace(low, rf"(?<=[^ ]) *(?=[{heads}])(?:(?:{titles}) *)+\z", ""))
    return F.when(F.substring(low, -4, 4).isin(*dict.fromkeys(t[-4:] for t in TITLE_SUFFIXES)), bare).otherwise(low)


def stopped(form: Column) -> Column:
    """Whether the scene decides whom a form means: pronouns, kinship words, bare titles and the like."""
    return F.lower(F.trim(form, F.lit(" \t\n\r\f\x0B"))).isin(*dict.fromkeys((*ALIAS_STOP, *TITLE_SUFFIXES)))


def descriptive(form: Column) -> Column:
    low = F.lower(trim(form))
    return (F.size(F.split(low, rf"{SPACE}+")) >= 3) & low.rlike(rf"^(?:{'|'.join(DESCRIPTIVE_HEADS)}) ")


def attributes_speech(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(text, SPACE, " "))).rlike(f" (?:{'|'.join(SPEECH_VERBS)})")


def hands_off(text: Column) -> Column:
    return text.rlike(rf":{SPACE}*\z")


def sentences(text: Column) -> Column:
    """Cut after an end mark that white space follows."""
    marked = F.regexp_replace(text, rf"([.!?…]){SPACE}+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), trim), lambda s: s != "")


def minor_parts(text: Column) -> Column:
    """Cut after a comma, semicolon, colon or dash that white space follows."""
    return F.filter(F.split(F.regexp_replace(text, rf"([,;:\-–—]){SPACE}+", "$1\x01"), "\x01"), lambda s: s != "")


def sentence_ends(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[.!?…]"))


def ends_sentence(text: Column) -> Column:
    return text.rlike(rf"[.!?…][\"”’')\]»]*{SPACE}*\z")


def gap_class(chunk: Column) -> Column:
    return F.when(chunk.rlike(rf"[.!?]{SPACE}*\z"), "sentence").otherwise("minor")


def gap_seconds(gap: Column) -> Column:
    return F.when(gap == "para", 0.7).when(gap == "minor", 0.3).otherwise(0.5)


def page_continues(before: Column, after: Column) -> Column:
    """Whether a paragraph runs on over a page break."""
    stripped = F.regexp_replace(before, rf"[\"”’')\]»]+\z", "")
    return before.endswith("-") | ~stripped.rlike(rf"[.!?…]{SPACE}*\z") | after.rlike(r"^\p{Ll}")


def title_fault(title: Column, headline_text: Column) -> Column:
    """The first rule that a title breaks; null if none."""
    t = trim(title)
    count = F.size(F.split(t, rf"{SPACE}+"))
    copied = F.regexp_replace(trim(F.regexp_extract(headline_text, "(?s)^[^:]*:(.*)", 1)), r"[ .…]+\z", "")
    return (
        F.when(title.isNull(), "missing").when(t == "", "empty").when(t.rlike("[?!]"), "punctuation").when(t.startswith("Chương"), "number")
        .when(count < 2, "one word").when(count > 10, "too long").when(F.contains(headline_text, F.lit(":")) & (copied == t), "copied")
    )


def respell(text: Column, word: Column, spelling: Column) -> Column:
    """word replaced by spelling if it occurs exactly once as a whole word."""
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.when(F.regexp_count(text, whole) == 1, F.regexp_replace(text, whole, spelling)).otherwise(text)


def replace_first(text: Column, before: Column, after: Column) -> Column:
    at = F.instr(text, before)
    return F.when((before != "") & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), after, F.substring(text, at + F.length(before), F.length(text)))).otherwise(text)


def sample_tags(stem: Column) -> Column:
    """Lower-cased parts between dashes, underscores and spaces, without numbers, once each."""
    return F.array_distinct(F.filter(F.transform(F.split(stem, "[-_ ]"), lambda w: F.lower(F.trim(w))), lambda w: (w != "") & ~w.rlike("^[0-9]+$")))


def normal_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, spaces to dashes, two synonyms resolved, once each."""
    clean = F.transform(tags, lambda t: F.regexp_replace(F.lower(F.trim(t)), " ", "-"))
    return F.array_distinct(F.filter(F.transform(clean, lambda t: F.when(t == "elderly", "old").when(t == "powerful", "strong").otherwise(t)), lambda t: t != ""))


def number_in_name(name: Column) -> Column:
    """Last run of digits of a file's stem; null for decimals and zero."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    found = F.regexp_extract(stem, r"(\.?)([0-9]+)[^0-9]*\z", 2)
    decimal = F.regexp_extract(stem, r"(\.?)([0-9]+)[^0-9]*\z", 1) == "."
    n = found.try_cast("int")
    return F.when(~decimal & (n > 0), n)


def inline_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1))


def strip_fences(text: Column) -> Column:
    s = F.regexp_replace(trim(text), "^﻿+", "")
    return trim(F.regexp_replace(F.regexp_replace(s, "^```json", ""), r"```\z", ""))


def strip_cues(phonemes: Column) -> Column:
    return F.regexp_replace(phonemes, r"<\|emotion_[0-9]+\|>|</?en>", "")


def emotion_parts(text: Column) -> Column:
    """Text and cues in turn, a cue being a bracketed span or an emotion token; empty text parts dropped."""
    marked = F.regexp_replace(text, r"(\[[^\]]*\]|<\|emotion_[0-9]*\|>)", "\x01$1\x01")
    return F.filter(F.split(marked, "\x01"), lambda p: p != "")
