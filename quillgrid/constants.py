"""Fixed values that results depend on."""

HISTOGRAM_BINS = 48
MIN_PEAK_SEPARATION_BINS = 3
MIN_SAMPLE_COUNT = 50
MIN_PAGE_SAMPLE_COUNT = 20
MIN_SEPARATION = 0.3
VALLEY_MARGIN_RATIO = 0.15
RUNNING_PAGE_FRACTION = 0.6
MAX_HEADING_LEVEL = 6
MIN_MEDIAN_SAMPLES = 3

# Ligatures U+FB00 to U+FB06 and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Vulgar fractions.
FRACTIONS = {"½": 1 / 2, "⅓": 1 / 3, "⅔": 2 / 3, "¼": 1 / 4, "¾": 3 / 4, "⅕": 1 / 5, "⅖": 2 / 5, "⅗": 3 / 5, "⅘": 4 / 5, "⅙": 1 / 6, "⅚": 5 / 6, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8, "⅞": 7 / 8}

# Lines, columns and blocks of a page; points unless a ratio.
SPANNING_WIDTH_RATIO = 0.7
HEADER_BAND = 0.93
FOOTER_BAND = 0.07
COLUMN_BIN = 2
MIN_VALLEY_WIDTH = 10
MAX_VALLEY_DENSITY = 0.05
MIN_VERTICAL_EMPTY = 0.7
MIN_COLUMN_SPAN = 0.5
BASELINE_RATIO = 0.3
LINE_GAP_BREAK = 1.8
INDENT_BREAK = 8
ISOLATION_GAP = 1.5
NEAR_IMAGE_MARGIN = 20
MAX_TABLE_LINE = 40
ROW_GAP_MEDIANS = 4
ROW_GAP_LEAST = 24

# Boxes of text items, placements of pictures, angles.
ITEM_DESCENT = 0.25
QUARTER_TURN_TOLERANCE = 25
MIRRORED_TILT_MAX = 45
UNUSUAL_ANGLE = 15

# Lines.
LINE_HEIGHT_RATIO = 1.35
SUBSCRIPT_RATIO = 0.8
TRACKING_RATIO = 1
BOLD_MAX_SHIFT = 0.5
DUPLICATE_LOOKAHEAD = 3

# Gap profiles without samples enough, as shares of the font size.
FALLBACK_INTRA = 0.25
FALLBACK_INTER = 0.6

# Running elements are grouped by steps of these many points.
RUNNING_POSITION_STEP = 3
RUNNING_WIDTH_STEP = 12

# Patterns of a profile.
MAX_PATTERN_LENGTH = 300
MAX_TEXT_LENGTH = 2000

# White space that trimming removes.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRUE_WORDS = ("true", "yes", "1", "x")
FALSE_WORDS = ("false", "no", "0", "")

# Pictures; points unless a share of the page, a ratio or pixels (EDGE).
BLEED_TOLERANCE = 1
FLUSH_MAX_OVERHANG = 2
FLUSH_MAX_AREA = 0.7
LARGE_SIDE = 300
EXTREME_ASPECT = 6
MASK_OVERLAP = 0.95
MASK_LOOK_BACK = 3
MASK_LOOK_AHEAD = 5
CO_MEMBER_SHARE = 0.05
GROUP_OVERLAP = 0.2
SCENE_AREA = 0.4
HANDOUT_AREA = 0.1
SCENE_EDGE = 2048
HANDOUT_EDGE = 1024
PORTRAIT_EDGE = 512
EDGE_MARGIN = 1.15
