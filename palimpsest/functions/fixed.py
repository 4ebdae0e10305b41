"""Fixed values of the dictionary formats. They must be as they are for right results; nothing else in the package hard-codes them."""

from __future__ import annotations

#: A gaiji token: its code stands in brackets.
TOKEN = r"\[([zh]A[0-9A-Fa-f]{3})\]"

#: Characters that count as white space, as a regular expression class without its brackets.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: What ends a line, besides "\n" after line ends were made one.
LINE_ENDS = r"\n\x0b\x0c\x1c-\x1e\x85  "

#: Pronunciation rewrites, in the order in which they apply.
PRONUNCIATION = [
    ("ei", "eɪ"), ("ai", "aɪ"), ("au", "aʊ"), ("oi", "ɔɪ"), ("ou", "oʊ"), ("juː", "ju:"), ("ɪː", "i:"), ("ɜː", "ɜ:"), ("ɔː", "ɔ:"), ("uː", "u:"),
    (r"ʃn\b", "ʃən"), (r"ʒn\b", "ʒən"), ("əbei", "əbeɪ"), ("əbeit", "əbeɪt"), ("əbeis", "əbeɪs"), ("eibi", "eɪbi"), ("baud", "baʊd"), ("dau", "daʊ"), ("juə", "ju"),
]

#: Markup of mapped bodies and what a reader sees for it.
BODY_MARKUP = {"<subentry>": "\n\n", "<derived>": "\n〔派生〕", "<usage>": "〔語法〕", "<sense-group>": "\n\n"}

#: Hyphens of headwords, as a class without its brackets; damaged hyphens.
HYPHENS = r"‐-―−"
BROKEN_HYPHENS = ["�]", "�[", "�^"]

#: Characters that body signatures leave out, as a class without its brackets; lengths of the two signatures.
SIGNATURE_DROPS = r"�\[\]<>〈〉()（）・:：;；,，.．\-―—"
SIGNATURE, PREFIX_SIGNATURE = 80, 40

#: A line that begins so is body text.
BODY_STARTS = ["〈", "（", "[", "［", "(", "〔", "《", "―", "—", "¶", "◆", "「"]
READING_MARKS = ["↓", "↑"]
ID_LINE = "[ID="
HEAD_PREFIX = "[zA423]"
#: Headers whose tokens stand for other characters than the token map says; replaced before it applies.
HEADER_LITERALS = {
    "おうおうと【〈[zA43B][zA43B]〉と】": "おうおうと【〈怏怏〉と】",
    "はん【[zA42E]】": "はん【頒】",
    "はんぷ【[zA42E]布】": "はんぷ【頒布】",
}
#: Rules for entries that no key finds. clues: all stand in the body, then the entry with the header; header: the entry's own header, then a
#: new entry of a header and a body.
MANUAL_CLUES = [(["つかまえる。「とんぼを―」", "皮算用"], "と・る【捕る】", "body_clue_known")]
MANUAL_HEADERS = [
    ("ひとたまりも―ない わずかの間も、もちこたえられない。", "ひとたまりも―ない", "わずかの間も、もちこたえられない。", "inline_source_line_split"),
    ("ひらべった・い", "ひらべった・い", "", "head_only_source_line"),
]

BLOCK_SIZES = [512, 1024, 2048]
KNOWN_BLOCKS = [0x000F, 0x3134]
#: Block sources: name and path below the root.
BLOCK_SOURCES = [("root_START", "START"), ("kokugo_START", "KOKUGO/START"), ("crcen_START", "CRCEN/START")]
#: Script scores: points and class of each kind of character; the kinds don't overlap. The last is the damage mark.
SCRIPT_SCORES = [(3, r"[぀-ヿ一-鿿]"), (1, r"[！-～A-Za-z]"), (2, r"[〈〉【】\[\]。、]"), (-10, r"�")]

#: Names of the exports' files and fields of their source, as other tools expect them.
DEFAULT_SOURCE = "crcen_START_2048"
TOKEN_MAP_FILE = "symbol_map_solved_initial.json"
PRONUNCIATION_DUMP, PRONUNCIATION_DRAFTS = "omiyage_02.txt", "entries_raw.jsonl"
PRONUNCIATION_OUTPUTS = ["old_text_pron_index", "entries_pron_enriched", "entries_pron_enriched_sample", "entries_pron_verified_index"]
PRONUNCIATION_REPORT = "entries_pron_enriched_report"
HEADLINE_DUMP, HEADLINE_DRAFTS = "test_dic.txt", "entries_master_kokugo_draft.jsonl"
HEADLINE_OUTPUTS = ["kokugo_old_text_index", "entries_master_kokugo_restored", "entries_master_kokugo_restored_index"]
HEADLINE_REPORT = "entries_master_kokugo_restored_report"
