"""Patterns, word lists and thresholds that decide results and therefore must not vary."""

# Whitespace as str.strip / str.isspace understand it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Java tests single characters below 256 in a class by one look-up; ranges and others it asks one after the other.
BREAKS = r"\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAKS = rf"[{BREAKS}](?:(?<=\r)\n)?"
RARE_BREAKS, WIDE_BREAKS = r"[\x0b\x0c\r\x1c\x1d\x1e\x85]", "\u2028\u2029"
# Between a break and what follows it: lines split here keep their breaks.
AFTER_BREAKS = rf"(?<=[{BREAKS}])(?<!\r(?=\n))"

# HTML
TAGGED = r"(?i)</?(?:p|div|br|html|body|span)\b"
DROPPED_ELEMENTS = ["script", "style", "head", "nav", "noscript"]
BLOCK_ELEMENTS = ["p", "div", "section", "article", "blockquote",
                  "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr"]

# Chapter headings
CHAPTER_PATTERN = (
    r"^(?:第[零〇一二三四五六七八九十百千万两\d]+[章节回卷部篇](?:\s*.*)?"
    r"|Chapter\s+\d+\b.*|序章(?:\s+.*)?|楔子(?:\s+.*)?|尾声(?:\s+.*)?)$"
)
HEADING_LIMIT = 100
NAVIGATION_NAME = r"(?i)(?:^|/)(?:nav|toc|contents)\.(?:xhtml|html|htm)$"

# Source headers
HEADER_MARKER = r"^<={3,}\s*Shaft\s+Novel\s+(Start|End)\s*={3,}>$"
HEADER_FIELDS = ["标题", "作者", "作者链接", "小说链接", "标签", "简介", "Title", "Author", "Tags", "Description"]
TITLE_FIELDS = ["标题", "title"]
AUTHOR_FIELDS = ["作者", "author"]
BODY_MARKERS = ["正文", "小说正文", "小说内容", "Body", "Content"]
HEADER_SITE = r"(?i)https?://(?:www\.)?pixiv\.net/"
HEADER_WINDOW = 80
HEADER_MIN_FIELDS = 3

# URLs: ASCII URL characters only; trailing punctuation belongs to the sentence.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
URL = (
    rf"(?i)[hw](?:(?<=h)ttps?://|(?<=w)ww\.)[{_LETTERS}]"
    rf"(?:[{_LETTERS}._~:/?#\[\]@!$&()*+,;=%-]*[{_LETTERS}_~:/#\[\]@$&(*+=%-])?"
)
URL_OPEN = rf"(?i)(?:https?://|www\.)[{_LETTERS}][{_LETTERS}._~:/?#\[\]@!$&()*+,;=%-]*"
MARKDOWN_LINK = r"(?i)\[([^\]\n]{0,500})\]\(\s*((?:https?://|www\.)[^\s)\n]+)\s*\)"
DOMAIN_SUFFIXES = ["com", "net", "org", "cn", "cc", "io", "me", "info", "xyz", "top", "site", "vip", "co", "tv"]
WRAPPED_BREAK = r"(?<![。！？!?…])\n(?!\n)"

# Audit previews
PREVIEW_ITEMS = 100
PREVIEW_CHARS = 500
PREVIEW_LIST = 20
PREVIEW_BLOCK = 2000
PREVIEW_TEXT = 4000

# Segmentation
BRACKETS = {"“": "”", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")"}
SENTENCE_MARKS = "。！？!?；;…"
CLAUSE_MARKS = "，,、：:"
FULL_STOPS = "。！？!?…"
TRAILERS = "”’」』。！？!?…\n \t"
BOUNDARY_PENALTY = {"paragraph": 0, "sentence": 15, "clause": 70, "chapter": 0}
WORD_BACKOFF = 30
TARGET_CHARS, MAX_CHARS, MIN_CHARS = 200, 300, 60
SPOKEN_LIMIT = 1000
TERM_LIMIT, REPLACEMENT_LIMIT = 200, 400

# Identity
SEED_MODULUS = 2**31 - 1
BASE_SEED = 20261001
RESERVED_CHARACTERS = r'[<>:"/\\|?*\x00-\x1f]'
DEVICE_NAMES = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?$"
FALLBACK_NAME = "book"
POLICY_EXECUTION_FIELDS = ["max_retry", "asr_python", "asr_model_path", "asr_timeout"]

# Quality
MIN_DURATION = 0.4
MIN_CHARS_PER_SECOND = 0.7
MAX_CHARS_PER_SECOND = 14.0
MAX_SILENCE_SECONDS = 3.0
SILENCE_DB = -45.0
MAX_CLIPPING_RATIO = 0.02
CLIPPED_LEVEL = 0.999
FRAME_SECONDS = 0.02
MAX_CER = 0.15
MAX_RETRY = 3

# Reference clips
CLIP_LIMIT = 5
SOURCE_SECONDS = 600.0
REFERENCE_SECONDS = 60.0
RANGE_SLACK = 0.05
SILENT_PEAK = 0.001
REFERENCE_CLIPPED_LEVEL = 0.995
REFERENCE_CLIPPED_SHARE = 0.001
EDGE_FLOOR, EDGE_SHARE, EDGE_PAD = 0.002, 0.015, 0.15
MIN_CLIP_SECONDS = 1.0
QUIET_RMS = 0.01
SILENT_SAMPLE, SILENT_SHARE = 0.003, 0.7
GAIN_CEILING, GAIN_PEAK = 4.0, 0.8
GAP_SECONDS = 0.2
SHORT_SECONDS, LONG_SECONDS = 3.0, 30.0
REFERENCE_RATE = 24000

# Work and jobs
LENGTH_RATIO = 1.6
LOOKAHEAD = 4
HISTORY_LIMIT = 32
PAUSES = {"paragraph": 0.45, "sentence": 0.18, "clause": 0.08, "hard": 0.08, "chapter": 1.0}
MEDIA_FORMATS = ["flac", "mp3", "wav"]
MEDIA_SUFFIXES = ["m4b", "mp3", "flac", "wav"]
ACTIVE_STATUSES = ["running", "preparing", "pausing", "cancelling", "stopping"]
TERMINAL_STATUSES = ["completed", "failed", "paused", "cancelled"]
DOWNLOAD_JOBS, DOWNLOAD_FILES = 100, 20000
REQUEST_LIMIT = 200
RECENT_LIMIT = 20
SHOWN_CHAPTERS = 12
LOG_LINES = 60
LOG_BYTES = 24000
