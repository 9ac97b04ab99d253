"""Queries of the string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.plans.spec import projection

_ID = ("id",)


def _train(columns):
    return projection("train", _ID, columns)


_WORDS = "trim(regexp_replace(lower(coalesce({c},'')),'[^a-z0-9]+',' ','g'))"
_TOKEN = "trim(regexp_replace(lower(coalesce({c},'')),'[^a-z0-9]+','_','g'),'_')"
_CLEAN = "trim(regexp_replace(regexp_replace(lower(coalesce({c},'')),'https?://\\S+',' ','g'),'[^a-z0-9]+',' ','g'))"
_UNESC = "trim(regexp_replace(replace(replace(lower(coalesce({c},'')),'&apos;',''''),'&amp;','&'),'\\s+',' ','g'),' ')"
_SQZ = "trim(regexp_replace(coalesce({c},''),'\\s+',' ','g'),' ')"
_PREF = "'{p}_'||coalesce(nullif({x},''),'missing')"
_FIRST = "coalesce(list_last(regexp_extract_all(lower(split_part(coalesce(authors,''),',',1)),'[a-z0-9]+')),'none')"
_VAR = {
    "title": ["title"], "title_venue": ["title", "venue"], "title_year": ["title", "year"], "title_author": ["title", "author"], "title_venue_year": ["title", "venue", "year"],
    "title_twice_venue": ["title", "title", "venue"], "all": ["title", "venue", "year", "author"],
}
_PART = {
    "title": _CLEAN.format(c="title"),
    "venue": _PREF.format(p="venue", x=_TOKEN.format(c="venue")),
    "year": _PREF.format(p="year", x=_TOKEN.format(c="cast(year as varchar)")),
    "author": _PREF.format(p="author", x=_TOKEN.format(c=f"({_FIRST})")),
}

QUERIES = {
    "c1_clean_token": _train(lambda: {"token": t.clean_token("venue")}),
    "c2_normalize_words": _train(lambda: {"words": t.normalize_words("title")}),
    "c3_clean_text": projection("documents", ("doc_id",), lambda: {"n": F.length(t.clean_text("text")), "h": F.md5(t.clean_text("text"))}),
    "c4_unescape_title": _train(lambda: {"words": t.unescape_title("title")}),
    "c5_search_title": _train(lambda: {"words": t.search_title("title")}),
    "c6_squeeze": projection("documents", ("doc_id",), lambda: {"h": F.md5(t.squeeze("text"))}),
    "c7_strip_tags": projection("abstracts_merged_v3", ("rec_id",), lambda: {"h": F.md5(t.strip_tags("abstract"))}),
    "c8_query_safe": _train(lambda: {"q": t.query_safe("title")}),
    "c9_normalize_doi": _train(lambda: {"doi_norm": t.normalize_doi("doi")}),
    "c10_last_segment": _train(lambda: {"segment": t.last_segment("doi")}),
    "c11_page_id": _train(lambda: {"page": t.page_id("doi")}),
    "c12_doi_kind": _train(lambda: {"kind": t.doi_kind("doi")}),
    "c13_first_author": _train(lambda: {"author": t.first_author_token("authors")}),
    "c14_first_author_surname": _train(lambda: {"surname": t.first_author_surname("authors")}),
    "c15_author_tokens": _train(lambda: {"first": t.prefixed(t.first_author_token("authors"), "author"), "full": t.prefixed("authors", "authors")}),
    "c16_prefix_tokens": _train(lambda: {"v": t.prefixed("venue", "venue"), "y": t.prefixed(F.col("year").cast("string"), "year")}),
    "c17_text_variants": _train(lambda: {n: F.md5(t.text_variant(n)) for n in _VAR}),
    "c18_document_template": projection("abstracts_merged_v3", ("rec_id",), lambda: {"h": F.md5(t.document_template("title", "s2_venue", "year", "abstract"))}),
    "c19_encoder_input": projection("abstracts_merged_v3", ("rec_id",), lambda: {"h": F.md5(t.encoder_input("title", "abstract"))}),
    "c20_length_features": _train(lambda: {"chars": F.length(F.coalesce("title", F.lit(""))), "words": t.word_count("title"), "authors": t.part_count("authors"), "has_authors": (t.squeeze("authors") != "").cast("int")}),
    "c21_first_pipe_value": _train(lambda: {"first": t.first_pipe_value(F.regexp_replace(F.col("title"), ": ", "|"))}),
    "c22_contains_any": _train(lambda: {"hit": t.contains_any("title", ("planning", "learning", "datalog"))}),
    "c23_keyword_groups": _train(lambda: {g: t.pattern_flag("title", p) for g, p in t.KEYWORD_GROUPS.items()}),
    "c24_signal_sum": _train(lambda: {"signal_sum": sum((t.pattern_flag("title", p) for p in t.KEYWORD_GROUPS.values()), F.lit(0))}),
    "c25_context_flags": _train(
        lambda: {
            "protected_venue": (t.clean_token("venue").rlike("^qorlim")).cast("int"),
            "meta_title": t.pattern_flag("title", ("preface", "editorial", "front pages")),
            "protected_logic": ((t.pattern_flag("title", t.KEYWORD_GROUPS["logic"]) == 1) & (t.pattern_flag("title", t.KEYWORD_GROUPS["data"]) == 0)).cast("int"),
            "safe_context": ((t.pattern_flag("title", t.KEYWORD_GROUPS["planning"]) == 1) & ~t.clean_token("venue").rlike("^qorlim")).cast("int"),
        }
    ),
    "c26_low_signal_title": _train(lambda: {"low": t.pattern_flag("title", ("^preface", "^editorial", "^front pages", "index$"))}),
    "c27_tokens": _train(lambda: {"tokens": F.array_join(t.tokens("title"), " ")}),
    "c28_slug": _train(lambda: {"slug": t.slug("doi")}),
    "c29_parsed_digit": _train(lambda: {"digit": t.parsed_digit("doi"), "onehot": F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.coalesce((i == t.parsed_digit("doi")).cast("int"), F.lit(0)).cast("string")), "")}),
}


def _rx(patterns) -> str:
    return "cast(regexp_matches(coalesce(title,''),'(?i)" + "|".join(patterns) + "') as int)"


_G = {g: _rx(p) for g, p in t.KEYWORD_GROUPS.items()}
_VENUE_HOT = f"regexp_matches({_TOKEN.format(c='venue')},'^qorlim')"
_STOP = ",".join(f"'{w}'" for w in t.STOP_WORDS)

ORACLES = {
    "c1_clean_token": f"select id, {_TOKEN.format(c='venue')} as token from train",
    "c2_normalize_words": f"select id, {_WORDS.format(c='title')} as words from train",
    "c3_clean_text": f"select doc_id, cast(length({_CLEAN.format(c='text')}) as int) as n, md5({_CLEAN.format(c='text')}) as h from documents",
    "c4_unescape_title": f"select id, {_UNESC.format(c='title')} as words from train",
    "c5_search_title": f"select id, trim(regexp_replace(regexp_replace({_UNESC.format(c='title')},'[^a-z0-9\\- ]',' ','g'),'\\s+',' ','g'),' ') as words from train",
    "c6_squeeze": f"select doc_id, md5({_SQZ.format(c='text')}) as h from documents",
    "c7_strip_tags": "select rec_id, md5(trim(regexp_replace(regexp_replace(coalesce(abstract,''),'<[^>]+>',' ','g'),'\\s+',' ','g'),' ')) as h from abstracts_merged_v3",
    "c8_query_safe": "select id, regexp_replace(coalesce(title,''),'[^a-zA-Z0-9 ]',' ','g') as q from train",
    "c9_normalize_doi": "select id, case when b like '10.%' then b else '' end as doi_norm from (select id, regexp_replace(lower(trim(coalesce(doi,''))),'^(?:https?://(?:dx\\.)?doi\\.[a-z]+/|doi:\\s*)','') as b from train)",
    "c10_last_segment": "select id, list_last(string_split(rtrim(coalesce(doi,''),'/'),'/')) as segment from train",
    "c11_page_id": "select id, lower(regexp_extract(coalesce(doi,''),'/paper/([0-9a-fA-F]{40})',1)) as page from train",
    "c12_doi_kind": "select id, case when d in ('','n/a','none','nan') then 'missing' when contains(d,'/paper/') then 'catalogue' when regexp_matches(d,'(^|/|:)\\s*10\\.\\d+/') then 'formal' when d like 'http%' then 'other_url' else 'other' end as kind from (select id, lower(trim(coalesce(doi,''))) as d from train)",
    "c13_first_author": f"select id, {_FIRST} as author from train",
    "c14_first_author_surname": "select id, lower(coalesce(list_last(regexp_extract_all(split_part(coalesce(authors,''),',',1),'[A-Za-zÀ-ÖØ-öø-ÿĀ-ſ''’-]+')),'none')) as surname from train",
    "c15_author_tokens": f"select id, {_PART['author']} as first, {_PREF.format(p='authors', x=_TOKEN.format(c='authors'))} as \"full\" from train",
    "c16_prefix_tokens": f"select id, {_PART['venue']} as v, {_PART['year']} as y from train",
    "c17_text_variants": "select id, " + ", ".join(f"md5(concat_ws(' ',{', '.join(_PART[p] for p in parts)})) as \"{n}\"" for n, parts in _VAR.items()) + " from train",
    "c18_document_template": f"select rec_id, md5(substring('Title: '||{_SQZ.format(c='title')}||' Venue: '||{_SQZ.format(c='s2_venue')}||' Year: '||coalesce(cast(year as varchar),'')||' Abstract: '||{_SQZ.format(c='abstract')},1,1800)) as h from abstracts_merged_v3",
    "c19_encoder_input": f"select rec_id, md5(case when {_SQZ.format(c='abstract')}='' then {_SQZ.format(c='title')} else {_SQZ.format(c='title')}||' [SEP] '||{_SQZ.format(c='abstract')} end) as h from abstracts_merged_v3",
    "c20_length_features": f"select id, cast(length(coalesce(title,'')) as int) as chars, cast(case when {_SQZ.format(c='title')}='' then 0 else len(string_split({_SQZ.format(c='title')},' ')) end as int) as words, cast(len(list_filter(string_split(coalesce(authors,''),','), lambda x: trim(x)<>'')) as int) as authors, cast({_SQZ.format(c='authors')}<>'' as int) as has_authors from train",
    "c21_first_pipe_value": "select id, coalesce(nullif(lower(trim(split_part(replace(coalesce(title,''),': ','|'),'|',1))),''),'none') as first from train",
    "c22_contains_any": "select id, cast(contains(lower(coalesce(title,'')),'planning') or contains(lower(coalesce(title,'')),'learning') or contains(lower(coalesce(title,'')),'datalog') as int) as hit from train",
    "c23_keyword_groups": "select id, " + ", ".join(f"{x} as \"{g}\"" for g, x in _G.items()) + " from train",
    "c24_signal_sum": "select id, " + "+".join(_G.values()) + " as signal_sum from train",
    "c25_context_flags": f"select id, cast({_VENUE_HOT} as int) as protected_venue, {_rx(('preface', 'editorial', 'front pages'))} as meta_title, cast({_G['logic']}=1 and {_G['data']}=0 as int) as protected_logic, cast({_G['planning']}=1 and not {_VENUE_HOT} as int) as safe_context from train",
    "c26_low_signal_title": f"select id, {_rx(('^preface', '^editorial', '^front pages', 'index$'))} as low from train",
    "c27_tokens": f"select id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(coalesce(title,'')),'[^a-z]+',' ','g')),' '), lambda w: length(w)>=3 and w not in ({_STOP})),' ') as tokens from train",
    "c28_slug": "select id, translate(coalesce(doi,''),'/\\ ','___') as slug from train",
    "c29_parsed_digit": "select id, d as digit, array_to_string(list_transform([1,2,3,4,5], lambda i: case when i=d then '1' else '0' end),'') as onehot from (select id, try_cast(nullif(regexp_extract(coalesce(doi,''),'[1-5]'),'') as int) as d from train)",
}
