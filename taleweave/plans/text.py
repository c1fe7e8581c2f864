"""Words, sentences, names, titles and marks over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.functions import text as fn
from taleweave.plans.common import S, pick, sql_list, sql_pick, sql_squeeze, sql_text, sql_trim, table
from taleweave.registry import query

_SPLIT = rf"list_filter(regexp_split_to_array(%s, '{S}+'), lambda w: w <> '')"
_EDGE = r"[^\p{L}\p{N}''’]"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


TITLES = ("A Night at Sea", "Chương 3", "Storm?", "One", "", None, "a b c d e f g h i j k l", "The Long Road", "Rain  over   Hills ")


@query("p19_headline", rf"SELECT doc_id, regexp_matches(line, '^{S}*(?:Chương|Chapter){S}*[0-9]') AS headline FROM (SELECT doc_id, {sql_pick(('Chapter 1: ', ' Chương 12', 'chapter 3', 'Chapter one'), 'doc_id')} || text AS line FROM documents)")
def headline(spark, sf_dir):
    line = F.concat(pick(("Chapter 1: ", " Chương 12", "chapter 3", "Chapter one"), F.col("doc_id")), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", fn.headline(line).alias("headline"))


@query(
    "p20_drop_headline",
    rf"""WITH seg AS (SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'Chapter 4 ' ELSE '' END || text AS text FROM conversations),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM seg)
    SELECT conv_id, turn, text FROM placed WHERE NOT (k = 1 AND regexp_matches(text, '^{S}*(?:Chương|Chapter){S}*[0-9]'))""",
)
def drop_headline(spark, sf_dir):
    from taleweave.operators.script import drop_headline as drop

    mark = F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 0), "Chapter 4 ").otherwise("")
    return drop(turns(spark, sf_dir).select("conv_id", "turn", F.concat(mark, F.col("text")).alias("text")), "conv_id", "turn")


_LINES = r"(SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\n') AS l FROM documents))"


def _lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


@query(
    "p21_quoted_term",
    rf"""SELECT doc_id, line, t <> '' AND NOT regexp_matches(t, '[\n.!?…]') AND length(t) <= 24 AND len(regexp_split_to_array(t, '{S}+')) <= 4 AS term
    FROM (SELECT doc_id, CAST(line AS INTEGER) AS line, {sql_trim("text")} AS t FROM {_LINES})""",
)
def quoted_term(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", fn.quoted_term(F.col("text")).alias("term"))


def _has(markers, words: str) -> str:
    bare = rf"replace(lower(regexp_replace(w, '^{_EDGE}+|{_EDGE}+\z', '', 'g')), '’', '''')"
    return f"len(list_filter({words}, lambda w: {bare} IN ({', '.join(sql_text(m) for m in markers)}))) > 0"


@query(
    "p23_first_person",
    rf"""SELECT conv_id, turn, {_has(fn.FIRST_PERSON, _SPLIT % 'text')} AS first_person,
      {_has(fn.THOUGHT_MARKERS, _SPLIT % rf"regexp_extract(text, '^((?:[^,]*,){{0,1}}[^,]*(?:,[^ \t\n\r\f\x0B]*)?)', 1)")} AS thought
    FROM (SELECT conv_id, turn, {sql_pick(('You know, ', 'Well, sir, yes, I ', '“My” word ', 'Their '), 'turn')} || text AS text FROM conversations)""",
)
def first_person(spark, sf_dir):
    text = F.concat(pick(("You know, ", "Well, sir, yes, I ", "“My” word ", "Their "), F.col("turn")), F.col("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", fn.first_person(text).alias("first_person"), fn.thought(text).alias("thought"))


@query("p24_speakable", r"SELECT doc_id, CAST(line AS INTEGER) AS line, regexp_matches(text, '[\p{L}\p{N}]') AS speakable FROM " + _LINES)
def speakable(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", fn.speakable(F.col("text")).alias("speakable"))


@query("p38_inline_tags", rf"SELECT doc_id, tags FROM (SELECT doc_id, regexp_extract_all({sql_pick(('[sigh] a [b c]', '[]x', 'plain [open', ''), 'doc_id')} || text, '\[([^\]]*)\]', 1) AS tags FROM documents)")
def inline_tags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.inline_tags(F.concat(pick(("[sigh] a [b c]", "[]x", "plain [open", ""), F.col("doc_id")), F.col("text"))).alias("tags"))


def sql_fold(x: str) -> str:
    return f"translate({x}, '{fn.FOLD_FROM}', '{fn.FOLD_TO}')"


NAMES = ("Huyền Vũ lão tổ", "Trần  Công (họ Trần)", "lão tổ", "Lý Tiểu Long sư huynh sư đệ", "Ân Đức", "Người áo đen", "Nữ tử áo trắng", "Anna (young)", "đại nhân tiền bối")
_CANON = (
    "trim(regexp_replace(trim(lower(trim(CASE WHEN ends_with(s, ')') AND contains(s, '(') THEN regexp_replace(s, '\\([^(]*\\)\\z', '') ELSE s END, ' ')), ' '), "
    f"'^(.*?[^ ]) *(?:(?:{'|'.join(fn.TITLE_SUFFIXES)}) *)+\\z', '\\1'), ' ')"
)


@query("p39_diacritic_filter", f"SELECT doc_id, contains({sql_fold('name')}, 'an') AS hit FROM (SELECT doc_id, {sql_pick(NAMES, 'doc_id')} AS name FROM documents)")
def diacritic_filter(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.contains(fn.fold(pick(NAMES, F.col("doc_id"))), fn.fold(F.lit("ÂN"))).alias("hit"))


@query(
    "p40_alias_stop",
    f"""SELECT doc_id, low IN ({', '.join(sql_text(t) for t in fn.TITLE_SUFFIXES)}) AS bare_title,
      len(regexp_split_to_array(low, '{S}+')) >= 3 AND regexp_matches(low, '^(?:{'|'.join(fn.DESCRIPTIVE_HEADS)}) ') AS descriptive
    FROM (SELECT doc_id, lower({sql_trim(sql_pick(NAMES, 'doc_id'))}) AS low FROM documents)""",
)
def alias_stop(spark, sf_dir):
    name = pick(NAMES, F.col("doc_id"))
    return docs(spark, sf_dir).select("doc_id", F.lower(F.trim(name)).isin(*fn.TITLE_SUFFIXES).alias("bare_title"), fn.descriptive(name).alias("descriptive"))


@query(
    "p41_page_continues",
    rf"""SELECT conv_id, turn, ends_with(text, '-') OR NOT regexp_matches(regexp_replace(text, '["”’'')\]»]+\z', ''), '[.!?…]{S}*\z')
      OR regexp_matches(after, '^\p{{Ll}}') AS continues
    FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) WHERE after IS NOT NULL""",
)
def page_continues(spark, sf_dir):
    from pyspark.sql import Window as W

    after = turns(spark, sf_dir).withColumn("after", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("after is not null")
    return after.select("conv_id", "turn", fn.page_continues(F.col("text"), F.col("after")).alias("continues"))


_T = sql_trim("title")
_COPIED = rf"regexp_replace({sql_trim(chr(34) + 'rest' + chr(34))}, '[ .…]+\z', '')"


@query(
    "p43_title_rules",
    rf"""SELECT doc_id, CASE WHEN title IS NULL THEN 'missing' WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '[?!]') THEN 'punctuation'
      WHEN starts_with(t, 'Chương') THEN 'number' WHEN n < 2 THEN 'one word' WHEN n > 10 THEN 'too long'
      WHEN contains(head, ':') AND {_COPIED} = t THEN 'copied' END AS fault
    FROM (SELECT doc_id, title, {_T} AS t, len(regexp_split_to_array({_T}, '{S}+')) AS n, head, regexp_extract(head, '(?s)^[^:]*:(.*)', 1) AS rest
      FROM (SELECT doc_id, {sql_pick(TITLES, 'doc_id')} AS title, 'Chapter 9: ' || {sql_pick(('The Long Road...', 'x y', 'A Night at Sea'), 'doc_id')} AS head FROM documents))""",
)
def title_rules(spark, sf_dir):
    head = F.concat(F.lit("Chapter 9: "), pick(("The Long Road...", "x y", "A Night at Sea"), F.col("doc_id")))
    return docs(spark, sf_dir).select("doc_id", fn.title_fault(pick(TITLES, F.col("doc_id")), head).alias("fault"))


@query(
    "p45_foreign_words",
    r"SELECT doc_id, list_filter(list_distinct_ordered, lambda w: w <> 'đen') AS words FROM (SELECT doc_id, list_filter(regexp_split_to_array(name, '[^\p{L}]+'), lambda w: regexp_matches(w, '[" + "".join(fn.FOLDS.values()) + rf"]')) AS list_distinct_ordered FROM (SELECT doc_id, {sql_pick(NAMES, 'doc_id')} AS name FROM documents))",
)
def foreign_words(spark, sf_dir):
    marked = F.filter(F.split(pick(NAMES, F.col("doc_id")), r"[^\p{L}]+"), lambda w: w.rlike("[" + "".join(fn.FOLDS.values()) + "]") & (w != "đen"))
    return docs(spark, sf_dir).select("doc_id", marked.alias("words"))


_LEADS = ("hắn Nói : ", "she walked in:", "Lão thì thầm ", "quiet. ")


@query(
    "p46_speech_attribution",
    rf"""SELECT doc_id, regexp_matches(' ' || lower(regexp_replace(lead, '{S}', ' ', 'g')), ' (?:{'|'.join(fn.SPEECH_VERBS)})') AS attributes, regexp_matches(lead, ':{S}*\z') AS hands_off
    FROM (SELECT doc_id, {sql_pick(_LEADS, 'doc_id')} AS lead FROM documents)""",
)
def speech_attribution(spark, sf_dir):
    lead = pick(_LEADS, F.col("doc_id"))
    return docs(spark, sf_dir).select("doc_id", fn.attributes_speech(lead).alias("attributes"), fn.hands_off(lead).alias("hands_off"))


@query("f03_sentences", rf"SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]){S}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS s FROM documents))")
def sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(fn.sentences(F.col("text"))).alias("pos", "sentence"))


@query("f05_sentence_ends", rf"SELECT doc_id, len(regexp_extract_all(text, '[.!?…]')) AS ends, regexp_matches(text, '[.!?…][\"”’'')\]»]*{S}*\z') AS closed FROM documents")
def sentence_ends(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.sentence_ends(F.col("text")).cast("long").alias("ends"), fn.ends_sentence(F.col("text")).alias("closed"))


@query("f08_minor_parts", rf"SELECT doc_id, list_filter(string_split(regexp_replace(text, '([,;:\-–—]){S}+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents")
def minor_parts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.minor_parts(F.col("text")).alias("parts"))


_GAP = rf"CASE WHEN regexp_matches(x, '[.!?]{S}*\z') THEN 'sentence' ELSE 'minor' END"


@query(
    "f10_gap_class",
    rf"SELECT doc_id, gaps, list_transform(gaps, lambda g: CASE g WHEN 'para' THEN 0.7::DOUBLE WHEN 'minor' THEN 0.3 ELSE 0.5 END) AS pauses FROM (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(text, '([,;:\-–—]){S}+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x: {_GAP}) AS gaps FROM documents)",
)
def gap_classes(spark, sf_dir):
    gaps = docs(spark, sf_dir).select("doc_id", F.transform(fn.minor_parts(F.col("text")), fn.gap_class).alias("gaps"))
    return gaps.withColumn("pauses", F.transform("gaps", fn.gap_seconds))


_CUES = ("[sigh] so <|emotion_3|> then", "<|emotion_|>a[b", "no cue", "a[laugh][cry]b")


@query("f11_emotion_parts", r"SELECT doc_id, list_filter(string_split(regexp_replace(x, '(\[[^\]]*\]|<\|emotion_[0-9]*\|>)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS parts FROM " + f"(SELECT doc_id, {sql_pick(_CUES, 'doc_id')} AS x FROM documents)")
def emotion_parts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.emotion_parts(pick(_CUES, F.col("doc_id"))).alias("parts"))


@query("f16_canon_key", f"SELECT doc_id, {_CANON} AS key FROM (SELECT doc_id, {sql_squeeze(sql_pick(NAMES, 'doc_id'))} AS s FROM documents)")
def canon_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.canon_key(pick(NAMES, F.col("doc_id"))).alias("key"))


@query("f17_corrected_source", "SELECT doc_id, replace(replace(replace(text, 'the', 'THE'), 'THEre', 'there'), 'on', '0n') AS text FROM documents")
def corrected_source(spark, sf_dir):
    fixes = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in (("the", "THE"), ("THEre", "there"), ("", "x"), ("on", "0n"))])
    fixed = F.aggregate(fixes, F.col("text"), lambda t, f: F.when(f["before"] != "", F.replace(t, f["before"], f["after"])).otherwise(t))
    return docs(spark, sf_dir).select("doc_id", fixed.alias("text"))


_WORDS = r"list_filter(regexp_split_to_array(%s, '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query("f18_words", f"SELECT doc_id, {_WORDS % 'text'} AS words FROM documents")
def words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.words(F.col("text")).alias("words"))


@query(
    "f19_word_alignment",
    f"""WITH pairs AS (SELECT doc_id, {_WORDS % 'text'} AS want, {_WORDS % "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN upper(text) WHEN 2 THEN text || ' extra' ELSE replace(text, 'the', 'teh') END"} AS got FROM documents)
    SELECT doc_id, CASE WHEN want = got THEN 'same' WHEN len(want) <> len(got) THEN 'changed'
      WHEN len(list_filter(range(1, len(want) + 1), lambda i: {sql_fold('want[i]')} <> {sql_fold('got[i]')})) > 0 THEN 'changed' ELSE 'slip' END AS alignment FROM pairs""",
)
def word_alignment(spark, sf_dir):
    from taleweave.operators.script import alignment

    got = F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, F.upper(F.col("text"))).when(F.col("doc_id") % 4 == 2, F.concat(F.col("text"), F.lit(" extra"))).otherwise(F.replace(F.col("text"), F.lit("the"), F.lit("teh")))
    return docs(spark, sf_dir).select("doc_id", alignment(fn.words(F.col("text")), fn.words(got)).alias("alignment"))


@query("f20_fold", f"SELECT doc_id, {sql_fold(sql_pick(NAMES, 'doc_id') + ' || text')} AS folded FROM documents")
def fold(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.fold(F.concat(pick(NAMES, F.col("doc_id")), F.col("text"))).alias("folded"))


@query(
    "f21_respell",
    r"""SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(' ' || regexp_replace(text, '[^\p{L}\p{N}]', '  ', 'g') || ' ', ' and ')) = 1
      THEN regexp_replace(text, '(^|[^\p{L}\p{N}])and($|[^\p{L}\p{N}])', '\1ánd\2') ELSE text END AS text FROM conversations""",
)
def respell(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", fn.respell(F.col("text"), F.lit("and"), F.lit("ánd")).alias("text"))


@query("f22_head_chars", "SELECT doc_id, substr(text, 1, 12) AS head, length(text) AS chars, strlen(text) AS bytes FROM documents")
def head_chars(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 12).alias("head"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("f24_speak_as_declared", "SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN substr(text, 1, instr(text, 'the') - 1) || '[cough]' || substr(text, instr(text, 'the') + 3) ELSE text END AS text FROM documents")
def speak_as_declared(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.replace_first(F.col("text"), F.lit("the"), F.lit("[cough]")).alias("text"))


_FILES = ("Ch.17 - A Title.mp3", "Ch.x - B.mp3", "Ch.2 - C.wav", "ch34.txt", "034 - Tên.txt", "part-7.5.txt", "0.txt", "none", "Ch.5 - A - B.mp3")


@query("f25_output_name", rf"SELECT doc_id, CAST(nullif(regexp_extract(f, '^Ch\.([0-9]+) - .*\.mp3\z', 1), '') AS INTEGER) AS number, nullif(regexp_extract(f, '^Ch\.[0-9]+ - (.*)\.mp3\z', 1), '') AS title FROM (SELECT doc_id, {sql_pick(_FILES, 'doc_id')} AS f FROM documents)")
def output_name(spark, sf_dir):
    f = pick(_FILES, F.col("doc_id"))
    number, title = F.regexp_extract(f, r"^Ch\.([0-9]+) - .*\.mp3\z", 1), F.regexp_extract(f, r"^Ch\.[0-9]+ - (.*)\.mp3\z", 1)
    return docs(spark, sf_dir).select("doc_id", number.try_cast("int").alias("number"), F.nullif(title, F.lit("")).alias("title"))


@query(
    "f26_number_in_name",
    rf"""SELECT doc_id, CASE WHEN regexp_extract(stem, '(\.?)([0-9]+)[^0-9]*\z', 1) <> '.' AND TRY_CAST(regexp_extract(stem, '(\.?)([0-9]+)[^0-9]*\z', 2) AS INTEGER) > 0
      THEN TRY_CAST(regexp_extract(stem, '(\.?)([0-9]+)[^0-9]*\z', 2) AS INTEGER) END AS number
    FROM (SELECT doc_id, regexp_replace({sql_pick(_FILES, 'doc_id')}, '(.)\.[^.]*\z', '\1') AS stem FROM documents)""",
)
def number_in_name(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.number_in_name(pick(_FILES, F.col("doc_id"))).alias("number"))


@query("f27_sample_tags", "SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || '-' || p_partkey || '_' || p_name, '[-_ ]'), lambda w: lower(trim(w, ' '))), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$')) AS words FROM part")
def sample_tags(spark, sf_dir):
    stem = F.concat("p_name", F.lit("-"), "p_partkey", F.lit("_"), "p_name")
    doubled = F.filter(F.transform(F.split(stem, "[-_ ]"), lambda w: F.lower(F.trim(w))), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    return table(spark, sf_dir, "part").select("p_partkey", doubled.alias("words"))


@query("f28_slug", r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-")).alias("slug"))


_RAW = ('```json\n{"a": 1}\n```', '﻿{"b": [1, 2,]}', ' {"c": {"d": 1,},} ', "```json```")


@query("f33_strip_fences", rf"SELECT doc_id, {sql_trim(rf'''regexp_replace(regexp_replace(regexp_replace({sql_trim('raw')}, '^﻿+', ''), '^```json', ''), '```\z', '')''')} AS body FROM (SELECT doc_id, [{', '.join('E' + sql_text(r.replace(chr(10), chr(92) + 'n')) for r in _RAW)}][doc_id % 4 + 1] AS raw FROM documents)")
def strip_fences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fn.strip_fences(pick(_RAW, F.col("doc_id"))).alias("body"))


@query("f35_comma_repair", rf"SELECT doc_id, regexp_replace({sql_pick(_RAW[1:3], 'doc_id')}, ',{S}*([}}\]])', '\1', 'g') AS body FROM documents")
def comma_repair(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.regexp_replace(pick(_RAW[1:3], F.col("doc_id")), rf",{S}*([}}\]])", "$1").alias("body"))


_SEAMS = (None, "door, bell", "none", "tags: slash , sword", "tags:", " wind ")


@query(
    "f36_seam_value",
    f"""SELECT doc_id, CASE WHEN v IS NULL THEN 'nothing' WHEN starts_with(trim(v, ' '), 'tags:') THEN 'tags' ELSE 'names' END AS kind,
      CASE WHEN v IS NULL THEN [] WHEN starts_with(trim(v, ' '), 'tags:') THEN list_filter(list_transform(string_split(substr(trim(v, ' '), 6), ','), lambda t: trim(t, ' ')), lambda t: t <> '')
        ELSE list_filter(list_transform(string_split(trim(v, ' '), ','), lambda t: trim(t, ' ')), lambda t: t <> '' AND lower(t) <> 'none') END AS parts
    FROM (SELECT doc_id, {sql_pick(_SEAMS, 'doc_id')} AS v FROM documents)""",
)
def seam_value(spark, sf_dir):
    from taleweave.operators.script import seam

    kind, parts = seam(pick(_SEAMS, F.col("doc_id")))
    return docs(spark, sf_dir).select("doc_id", kind.alias("kind"), parts.alias("parts"))


@query("u01_word_set", r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> ''))) AS words FROM documents")
def word_set(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_sort(fn.letter_words(F.col("text"))).alias("words"))


_TAGS = (["Elderly", " powerful "], ["old", "elderly", "Dark Cave"], ["x", ""], ["weak"])


@query(
    "u15_normal_tags",
    f"""SELECT doc_id, list_filter(list_transform(t, lambda x: CASE x WHEN 'elderly' THEN 'old' WHEN 'powerful' THEN 'strong' ELSE x END), lambda x: x <> '')[:1] AS first_tag
    FROM (SELECT doc_id, list_transform([{', '.join(sql_list(t) for t in _TAGS)}][doc_id % 4 + 1], lambda x: replace(lower(trim(x, ' ')), ' ', '-')) AS t FROM documents)""",
)
def normal_tags(spark, sf_dir):
    tags = F.element_at(F.array(*[F.array(*[F.lit(x) for x in t]) for t in _TAGS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.slice(fn.normal_tags(tags), 1, 1).alias("first_tag"))


@query("f32_token_estimate", "SELECT doc_id, greatest(1, length(text) // 3) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 3)).cast("long").alias("tokens"))


@query("v10_inline_tag_refusal", rf"SELECT doc_id FROM documents WHERE regexp_matches({sql_pick(('[sigh] ', '', '[', 'a[b]'), 'doc_id')} || text, '\[[^\]]*\]')")
def inline_tag_refusal(spark, sf_dir):
    text = F.concat(pick(("[sigh] ", "", "[", "a[b]"), F.col("doc_id")), F.col("text"))
    return docs(spark, sf_dir).where(F.size(fn.inline_tags(text)) > 0).select("doc_id")


@query("v05_nonverbal", "SELECT doc_id, (length(text) - length(replace(text, 'and', ''))) // 3 AS hits, doc_id % 3 <> 0 AND (length(text) - length(replace(text, 'and', ''))) // 3 = 1 AS valid FROM documents")
def nonverbal(spark, sf_dir):
    hits = F.floor((F.length("text") - F.length(F.replace(F.col("text"), F.lit("and"), F.lit("")))) / 3)
    return docs(spark, sf_dir).select("doc_id", hits.alias("hits"), ((F.col("doc_id") % 3 != 0) & (hits == 1)).alias("valid"))
