"""Fixed values that the results depend on."""

SEARCH_CANDIDATES = 50
RRF_K = 60
CHUNK_TOKENS, CHUNK_MAX = 256, 480
GROUP_TOKENS, GROUP_MAX, LINE_COST = 3000, 6000, 4
SNIPPET = 160
EDGE_Y, EDGE_X = 0.10, 0.08
DECORATION_PAGES = 2
BM25_K1, BM25_B = 1.2, 0.75
KG_MAX, KG_CONCEPTS = 60, 15
MAP_IOU, MAP_LIKE, MAP_SIMILARITY = 0.5, 0.5, 0.9
PAGE_WIDTH, PAGE_HEIGHT, LINES_PER_PAGE = 612, 792, 10
MOST_LEVELS = 4
PREAMBLE, CONTINUED = "标题与摘要", "（续）"
ABSTRACT_SHARE = 0.25
EXTRACT_CHARS, LEAST_BODY = 12000, 40
MOST_NAME, MOST_DESCRIPTION, MOST_EVIDENCE, MOST_ALIASES, MOST_VALUE = 200, 300, 200, 10, 40
CONFIDENCE, UNSUPPORTED = 0.8, 0.7
ENTITY_TYPES = ("Task", "Method", "Dataset", "Metric", "Model", "Concept")
RELATION_TYPES = ("proposes", "uses", "improves_on", "evaluated_on", "achieves", "compares_with", "part_of")
SAME_COLUMN = 150
BLOCK_TERMS = 24
FIGURE_GAP = 20.0
