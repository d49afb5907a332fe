"""They must equal the evaluated benchmark's own for right results."""

# --- place categories -------------------------------------------------------
HOTEL_CATEGORIES = (
    "舒适型", "经济型", "高档型", "民宿", "商务酒店",
    "豪华型", "快捷酒店", "旅馆", "客栈", "度假酒店",
    "电竞酒店", "公寓式酒店", "主题酒店",
)
EXCLUDED_CATEGORIES = {
    "attractions": ("旅游景点", "滑雪", "游客中心"),
    "food": ("食堂", "米粉"),
}
FALLBACK_CATEGORIES = {"attractions": "公园", "food": "中餐", "hotels": "商务酒店"}

# --- administrative names ---------------------------------------------------
CITY_KEY_SUFFIXES = ("市", "区", "县", "自治州", "地区")
CITY_TRY_SUFFIXES = ("市", "省", "区", "县", "州", "盟", "旗", "地区")
PLACEHOLDER_SUFFIX = "市辖区"
TERMINAL_SUFFIXES = ("省", "市", "区", "县", "旗", "盟", "州", "地区", "林区", "特区")

# --- preference paths -------------------------------------------------------
CANONICAL_SEGMENTS = (
    "global_constraints", "city_specific_preferences", "hotel_preference",
    "category_pref", "must_visit", "reject_visit", "must_eat", "prefer_eat",
    "avoid_eat", "reject_eat", "max_poi_per_day", "max_active_hours", "avg_budget",
)
PATH_PREFIXES = ("global_constraints.", "city_specific_preferences.")
MAX_EDITS_PER_USER = 2
GLOBAL_SECTION, CITY_SECTION = "global_constraints", "city_specific_preferences"
GLOBAL_SCALARS = ("avg_budget", "intensity.max_poi_per_day", "intensity.max_active_hours")
GLOBAL_LISTS = (
    "transport.must", "transport.prefer", "transport.avoid", "transport.reject",
    "hotel_preference.prefer", "hotel_preference.avoid",
)
CITY_LISTS = (
    "attractions.must_visit", "attractions.reject_visit",
    "attractions.category_pref.positive", "attractions.category_pref.negative",
    "food.must_eat", "food.prefer_eat", "food.avoid_eat", "food.reject_eat",
)

# --- activities -------------------------------------------------------------
SPLITTABLE_TYPES = ("attraction", "food", "rest", "intracity_transport")
STRONG, WEAK = 2, 1

# --- run settings and failures ----------------------------------------------
AGENT = "Agent"
DIFFICULTY_SETTINGS = {"easy": (15, 3), "medium": (20, 4), "hard": (25, 5)}
RETRYABLE_REASONS = ("rate_limit", "connection_error")

# --- chat text --------------------------------------------------------------
PASS_TOKEN = "[pass]"
PLACEHOLDER_START = "(对话开始)"
PLACEHOLDER_SILENT = "(其他参与者暂无发言)"
JUDGE_CUT_MARK = "\n  ... (结果已截断)"

# The syntax of a fenced block, of trailing pass tokens and of a trailing edit marker. ``\z`` is the
# true end of text in Java, ``(?d)`` keeps "." from stopping at anything but a line feed.
JSON_FENCE = r"```json\s*(\{[\s\S]*?\})\s*```"
PASS_END = r"(?iU)(?:\s*\[pass\]\s*)+\z"
MARKER = r"(?Ud)\[\s*([\w.]+)\s*:\s*(.+?)\s*\]\s*\z"

# --- judge ------------------------------------------------------------------
RATINGS = {"极差": 1, "较差": 2, "一般": 3, "较好": 4, "优秀": 5}
RATING_PREFIXES = ("评级：", "评级:")
JUDGE_DIMENSIONS = (
    "hallucination_factuality", "tool_usage_reasoning", "interaction_quality",
    "conflict_coordination", "plan_humanization",
)
EXAMPLES_PER_MISS = 8

# --- tool arguments: name -> (type, may be null) ----------------------------
TOOL_PARAMS = {
    "maps_geo": {"address": ("string", False), "city": ("string", True)},
    "maps_weather": {"location": ("string", False), "date": ("string", False),
                     "days": ("integer", False)},
    "travel_search_flights": {
        "origin": ("string", False), "destination": ("string", False),
        "date": ("string", False), "depart_time_start": ("string", True),
        "depart_time_end": ("string", True), "sort_by": ("string", True),
        "airport": ("string", True)},
    "travel_search_trains": {
        "origin": ("string", False), "destination": ("string", False),
        "date": ("string", False), "depart_time_start": ("string", True),
        "depart_time_end": ("string", True), "sort_by": ("string", True),
        "train_type_filter": ("string", True)},
    "web_search": {"query": ("string", False)},
    "search_poi": {
        "keywords": ("string", False), "city": ("string", False),
        "region": ("string", True), "location": ("string", True),
        "radius_km": ("number", True), "price_min": ("number", True),
        "price_max": ("number", True), "sort_by": ("string", True),
        "page": ("integer", False), "page_size": ("integer", False)},
    "get_poi_detail": {"id": ("string", False)},
    "plan_route": {
        "origin": ("string", False), "destination": ("string", False),
        "mode": ("string", False), "city": ("string", True),
        "date": ("string", True), "time": ("string", True)},
    "compare_routes": {"origin": ("string", False), "destination": ("string", False),
                       "city": ("string", True)},
    "search_along_route": {
        "origin": ("string", False), "destination": ("string", False),
        "keywords": ("string", False), "mode": ("string", False),
        "city": ("string", True), "route_range": ("integer", False),
        "route_index": ("integer", False), "poi_limit": ("integer", False)},
}
TOOL_REQUIRED = {
    "maps_geo": ("address",),
    "maps_weather": ("location", "date"),
    "travel_search_flights": ("origin", "destination", "date"),
    "travel_search_trains": ("origin", "destination", "date"),
    "web_search": ("query",),
    "search_poi": ("keywords", "city"),
    "get_poi_detail": ("id",),
    "plan_route": ("origin", "destination"),
    "compare_routes": ("origin", "destination"),
    "search_along_route": ("origin", "destination", "keywords"),
}
TOOL_NAMES = tuple(TOOL_PARAMS)
SORT_VALUES = {
    "travel_search_flights": ("depart_time", "price", "duration"),
    "travel_search_trains": ("depart_time", "depart_time_desc", "duration", "price"),
    "search_poi": ("relevance", "distance", "rating", "price_low", "price_high"),
}
TRAIN_FILTERS = ("high_speed", "high_speed_and_emu", "regular")
ROUTE_MODES = {
    "plan_route": ("transit", "driving", "walking", "bicycling"),
    "search_along_route": ("driving", "walking", "bicycling"),
}
MAX_WEATHER_DAYS = 4
MAX_PAGE_SIZE = 20
MAX_ROUTE_RANGE = 3000
MAX_ROUTE_POIS = 50
