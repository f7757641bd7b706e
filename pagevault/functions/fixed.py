"""Word lists, patterns and constants that results depend on. Plain data, no logic."""

# URL pattern -> page type, in order of precedence (first match wins, anchored at the start).
PAGE_TYPE_RULES = [
    (r"https://mail\.google\.com/mail/u/\d+/\#inbox(\?.+)?$", "gmail_inbox"),
    (r"https://www\.instagram\.com/?(\?.+)?$", "instagram_home"),
    (r"https://www\.instagram\.com/direct/inbox/?(\?.+)?$", "instagram_inbox"),
    (r"https://www\.instagram\.com/explore/search/.*", "instagram_explore_search"),
    (r"https://www\.instagram\.com/explore/.*", "instagram_explore"),
    (r"https://www\.instagram\.com/([^/]+)/saved/.*", "instagram_saved_collection"),
    (r"https://www\.instagram\.com/([^/]+)/?(\?.+)?$", "instagram_profile"),
    (r"https://www\.threads\.net/activity/?(\?.+)?$", "threads_activity"),
    (r"https://www\.threads\.net/?(\?.+)?$", "threads_home"),
    (r"https://bsky\.app/?(\?.+)?$", "bsky_feed"),
    (r"https://bsky\.app/profile/([^/]+)/follows(\?.+)?$", "bsky_followers"),
    (r"https://bsky\.app/profile/([^/]+)/followers(\?.+)?$", "bsky_followers"),
    (r"https://bsky\.app/profile/([^/]+)/?(\?.+)?$", "bsky_profile"),
    (r"https://www\.linkedin\.com/company/([^/]+)/about/?(\?.+)?$", "linkedin_company_about"),
    (r"https://www\.linkedin\.com/company/([^/]+)/people/?(\?.+)?$", "linkedin_company_people"),
    (r"https://www\.linkedin\.com/company/([^/]+)/posts/.*", "linkedin_feed"),
    (r"https://www\.linkedin\.com/company/([^/]+)/?(\?.+)?$", "linkedin_company"),
    (r"https://www\.linkedin\.com/messaging/.*", "linkedin_messages"),
    (r"https://www\.linkedin\.com/in/([^/]+)/recent-activity/.*", "linkedin_feed"),
    (r"https://www\.linkedin\.com/in/([^/]+)/?(\?.+)?$", "linkedin_profile"),
    (r"https://www\.linkedin\.com/mynetwork/invite-connect/connections/?(\?.+)?$", "linkedin_connections"),
    (r"https://www\.linkedin\.com/mynetwork/network-manager/people-follow/followers/.*", "linkedin_followers"),
    (r"https://www\.linkedin\.com/mynetwork/network-manager/people-follow/following/.*", "linkedin_followers"),
    (r"https://www\.linkedin\.com/search/results/people/.*", "linkedin_search_people"),
    (r"https://www\.linkedin\.com/feed/followers/.*", "linkedin_followers"),
    (r"https://www\.linkedin\.com/feed/.*", "linkedin_feed"),
    (r"https://(x|twitter)\.com/home(\?.+)?$", "twitter_home"),
    (r"https://(x|twitter)\.com/messages.*", "twitter_inbox"),
    (r"https://(x|twitter)\.com/i/bookmarks(\?.+)?$", "twitter_bookmarks"),
    (r"https://(x|twitter)\.com/([^/]+)/likes(\?.+)?$", "twitter_likes"),
    (r"https://(x|twitter)\.com/([^/]+)/followers(\?.+)?$", "twitter_followers"),
    (r"https://(x|twitter)\.com/([^/]+)/status/(\d+)(\?.+)?$", "twitter_thread"),
    (r"https://(x|twitter)\.com/([^/]+)/?(\?.+)?$", "twitter_profile"),
    (r"https://www\.youtube\.com/feed/history(\?.+)?$", "youtube_history"),
    (r"https://www\.youtube\.com/?(\?.+)?$", "youtube_home"),
]

# Containers tried for main content, in order.
MAIN_CONTENT_SELECTORS = [
    "article",
    "main",
    ".post-content",
    ".post-wrapper",
    ".post",
    ".content-wrapper",
    ".content",
    "#content",
    ".main",
    "#main",
    ".container",
    ".page",
]

# Tags whose whole subtree is dropped before anything is read.
DROPPED_TAGS = ["script", "style", "noscript", "svg", "iframe", "canvas"]

# The text of the tool's own banner, which is dropped where it stands in a page (in any case of letters, on one line; all white space counts).
BANNER_PATTERN = r"(?iu)🥦[\s\x1c-\x1f\x85\p{Z}]*reading[^\n]*?(?:pages|\.\.\.)"

# Tags that never reach the Markdown.
UNCONVERTED_TAGS = ["meta", "link", "head", "path", "footer", "nav", "header", "button", "input"]

# First-line code artefacts.
CODE_HEAD_PATTERN = r"function|document|window|\{|\}|var|const|let|==|=>|\(self|\[0\]"

# Interface phrases that mark a line as noise (case-insensitive).
NOISE_PHRASES = [
    "Media player modal window",
    "Visit profile for",
    "Drop your files here",
    "Drag your files here",
    "Discover free and easy ways",
    "are you hiring?",
    "Write article",
    "feed updates",
    "Visible to anyone on or off LinkedIn",
    "Media is loading",
    "Loaded:",
    "Stream Type LIVE",
    "Remaining time",
    "Current time",
    "Duration",
    "Activate to view larger image",
]

# Words that mark an element as noise when also found in a class name.
UI_WORDS = ["loading", "progress", "spinner", "advertisement", "cookie", "banner"]

# Section headers to skip, then headers to keep.
SKIPPED_SECTIONS = [
    "To view keyboard shortcuts",
    "Messages",
    "Pinned by people you follow",
    "Live on X",
    "Who to follow",
    "Explore",
]
KEPT_SECTIONS = ["Your Home Timeline", "Trending now"]

# Role words.
LEADERSHIP_ROLES = [
    "founder", "co-founder", "ceo", "cto", "coo", "cfo", "chief", "president", "vice president", "vp",
    "executive", "director", "head", "lead", "principal", "manager", "chair", "chairman", "chairwoman",
    "chairperson", "board member",
]
TECHNICAL_ROLES = [
    "engineer", "developer", "programmer", "architect", "administrator", "devops", "sre", "reliability",
    "security", "data scientist", "ml engineer", "ai", "backend", "frontend", "full-stack", "fullstack",
    "mobile", "web", "cloud", "infrastructure", "network", "systems", "qa", "quality", "test", "testing",
    "database", "dba", "analytics", "analyst", "research", "scientist",
]
BUSINESS_ROLES = [
    "product", "project", "program", "marketing", "growth", "sales", "account", "customer success",
    "operations", "hr", "human resources", "talent", "recruiter", "recruiting", "business development",
    "partnerships", "strategy", "consultant", "advisor", "finance", "financial", "accounting", "legal",
    "compliance", "design", "ux", "ui", "content", "communication",
]
SENIORITY_ROLES = [
    "senior", "sr", "junior", "jr", "staff", "principal", "associate", "intern", "apprentice", "fellow",
    "lead", "head of", "chief", "executive", "director",
]
RELATIONSHIP_WORDS = [
    " at ", "@", " in ", " with ", " for ", "•", " of ", "|", "→", " - ", "&", "and", "working on",
    "specializing in",
]
CONNECTION_DEGREES = ["connection", "degree", "2nd", "3rd", "1st"]
CONNECTION_MUTUAL = ["mutual", "shared", "common"]
CONNECTION_PHRASES = [
    "are mutual", "is a mutual", "other mutual", "you both know", "you and", "both follow", "connected",
    "profile", "your network",
]
NON_NAME_WORDS = [
    "@", "#", "http", ".com", "followers", "employees", "industry", "location", "linkedin", "website",
    "founded", "company", "page", "works at", "profile", "see all", "mountain view", "california", "ca",
    "san francisco", "new york", "success",
]
LOCATION_WORDS = [
    "headquartered in", "based in", "located in", "location:", "offices in", "hq in", "hq:",
    "headquarters:", "main office:", "global hq", "regional hq", "primary location", "address:", "greater",
    "area of", "region of", "metropolitan area", "metro area", "bay area", "region", "district",
]
FOUNDING_WORDS = [
    "founded", "established", "est.", "started", "launched", "created", "inception", "since",
]
ADDRESS_WORDS = ["Street", "Ave", "Boulevard", "Rd", "Suite"]

# Months.
MONTHS = [
    "JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER",
    "NOVEMBER", "DECEMBER",
]

# Date patterns in order of preference.
DATE_PATTERNS = [
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}(?:,\s*\d{4})?",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}",
    r"\b\d{1,2}-\d{1,2}-\d{2,4}",
    r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    r"\b\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)",
    r"\b(?:Today|Yesterday)\b",
    r"\b\d+\s+(?:minute|hour|day|week|month)s?\s+ago\b",
]

# Affixes.
BYLINE_PREFIXES = ["By ", "by ", "Author: ", "Written by "]
HISTORY_PREFIX = "Watched "
AVATAR_SUFFIX = "'s profile picture"

# Machine-made caption texts.
CAPTION_MARKERS = ["Puede ser una imagen de", "No photo description available", "No hay ninguna descripción"]

# Action words before a biography, then interface words removed from it, in order.
FOLLOW_ACTIONS = ["Follow", "Following", "Follows you", "Click to Follow", "Click to Unfollow"]
FOLLOW_WORDS = [
    "to Follow", "Follow back", "to Unfollow", "Click to", "youClick", "you", "Click", "youFollowingClick",
]

# Metadata precedence. Each entry: (attribute that names the tag, its value).
AUTHOR_METAS_FIRST = [
    ("property", "og:author"),
    ("property", "article:author"),
    ("name", "author"),
    ("itemprop", "author"),
]
BYLINE_CLASSES = ["byline", "author", "article-byline", "post-author", "entry-author"]
DATE_METAS = [
    ("property", "article:published_time"),
    ("property", "og:published_time"),
    ("name", "published_time"),
    ("itemprop", "datePublished"),
    ("name", "DC.date.issued"),
    ("name", "pubdate"),
    ("name", "lastmod"),
    ("name", "date"),
]
JSONLD_DATES = ["datePublished", "dateCreated", "publishedAt", "dateModified"]
FAVICON_RELS = ["icon", "shortcut icon", "apple-touch-icon"]

# Limits.
MIN_MATCH_RATIO = 0.3
CHUNK_HARD = 3000
CHUNK_SOFT = 2000
CHUNK_COMBINE = 1500
EMBED_BATCH = 1000
THROTTLE_MS = 250
DEBOUNCE_GAP_MS = 750
