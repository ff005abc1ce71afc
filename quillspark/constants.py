"""Word lists, patterns, limits and weights that search results depend on."""

from __future__ import annotations

# ---- files -----------------------------------------------------------------------------------------------------------
TEXT_EXTENSIONS = ("txt", "md")
PAGED_EXTENSIONS = ("pdf",)
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff")
EXTENSIONS = TEXT_EXTENSIONS + PAGED_EXTENSIONS + IMAGE_EXTENSIONS
EXCLUDED_DIRECTORIES = (".git", "node_modules", ".next", "dist", "build", "target", "appdata", "caches")
MAX_BYTES = 64 * 1024 * 1024
MIME_TYPES = {
    "txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "webp": "image/webp", "bmp": "image/bmp", "gif": "image/gif", "tif": "image/tiff", "tiff": "image/tiff",
}

# ---- chunks and regions ----------------------------------------------------------------------------------------------
CHUNK_WORDS, CHUNK_OVERLAP = 350, 60
REGIONAL_LINES, REGIONAL_LEAST_CHARACTERS = 5, 8
GRID_ABOVE, GRID_TILE, SLICE_FROM, MAX_REGIONS = 4096, 1536, 1024, 12

# ---- search ----------------------------------------------------------------------------------------------------------
RRF_K = 60
CHANNEL_LIMITS = {"exact": 50, "semantic": 50, "visual": 100, "visual_tag": 100, "document_type": 40, "entity": 40, "metadata": 40, "filename": 50}
MAX_RESULTS = 20
SEMANTIC_MODERATE = 0.85
WEIGHTS = {
    "exact_identifier": {"exact": 0.55, "semantic": 0.05, "visual": 0.05, "entity": 0.20, "metadata": 0.15},
    "visual": {"exact": 0.08, "semantic": 0.05, "visual": 0.75, "visual_tag": 0.05, "metadata": 0.02, "filename": 0.05},
    "category": {"exact": 0.25, "semantic": 0.20, "visual": 0.05, "visual_tag": 0.10, "document_type": 0.30, "metadata": 0.10},
    "date_filtered": {"exact": 0.20, "semantic": 0.35, "visual": 0.30, "metadata": 0.10, "filename": 0.05},
    "other": {"exact": 0.20, "semantic": 0.20, "visual": 0.10, "visual_tag": 0.05, "document_type": 0.15, "entity": 0.15, "metadata": 0.10, "filename": 0.05},
}
BM25_K1, BM25_B = 1.2, 0.75
SNIPPET_BEFORE, SNIPPET_LENGTH = 80, 420
MAD_SCALE, MAD_FLOOR = 1.4826, 0.01
MCUT_FLOOR = 0.20

# ---- query words -----------------------------------------------------------------------------------------------------
STOP_WORDS = (
    "the a an my me of for to in on at with and or is are find show search get give all any some that this these those please from about "
    "containing contains screenshot screenshots image images photo photos picture pictures"
).split()
VISUAL_WORDS = (
    "photo", "photos", "photograph", "picture", "pic", "pics", "image", "images", "looks like", "look like", "looking", "screenshot of a", "colored", "colour",
    "red", "blue", "green", "yellow", "black", "white", "orange", "purple", "pink", "poster", "scene", "wallpaper", "logo", "qr code", "chart", "graph", "map",
)
CATEGORY_WORDS = (
    "receipt", "receipts", "invoice", "invoices", "ticket", "tickets", "booking", "bookings", "reservation", "document", "documents", "warranty", "id", "form",
    "payment", "payments", "purchase", "purchases",
)
FILE_TYPE_WORDS = (("pdf", "pdf"), ("pdfs", "pdf"), ("markdown", "md"), ("text file", "txt"), ("png", "png"), ("jpeg", "jpeg"), ("jpg", "jpg"))
DATE_WORDS = (
    "today", "yesterday", "tomorrow", "last month", "this month", "last week", "this week", "last year", "this year", "recent", "recently", "days ago", "weeks ago",
    "months ago", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
FILENAME_WORDS = ("file named", "filename", "named", "called", "file:")
FOLDER_WORDS = ("folder", "directory", "in folder", "under folder")
TEXTUAL_WORDS = (
    "note notes document documents email emails invoice invoices receipt receipts ticket tickets code error errors file files pdf markdown text spreadsheet presentation"
).split()
DOCUMENT_PHRASES = (
    ("railway booking confirmation", "train_ticket"), ("train reservation", "train_ticket"), ("railway tickets", "train_ticket"), ("railway ticket", "train_ticket"),
    ("train tickets", "train_ticket"), ("train ticket", "train_ticket"), ("flight tickets", "flight_ticket"), ("flight ticket", "flight_ticket"),
    ("boarding pass", "flight_ticket"), ("bus tickets", "bus_ticket"), ("bus ticket", "bus_ticket"), ("movie tickets", "movie_ticket"), ("movie ticket", "movie_ticket"),
    ("event tickets", "event_ticket"), ("event ticket", "event_ticket"), ("hotel reservation", "hotel_reservation"),
)
DOCUMENT_EXPANSIONS = (
    ("ticket", ("flight_ticket", "train_ticket", "bus_ticket", "movie_ticket", "event_ticket")),
    ("booking", ("flight_ticket", "train_ticket", "bus_ticket", "movie_ticket", "event_ticket", "hotel_reservation")),
    ("reservation", ("hotel_reservation", "flight_ticket", "train_ticket")),
    ("payment", ("payment_receipt", "invoice")),
    ("receipt", ("payment_receipt", "invoice")),
    ("invoice", ("invoice", "payment_receipt")),
    ("purchase", ("invoice", "payment_receipt")),
)
STORED_TYPES = {"train_ticket": "train_ticket", "flight_ticket": "flight_ticket", "hotel_reservation": "hotel_booking", "payment_receipt": "receipt", "invoice": "invoice"}
DOCUMENT_LABELS = ("flight_ticket", "train_ticket", "bus_ticket", "movie_ticket", "event_ticket", "hotel_reservation", "payment_receipt", "invoice")
#: (type, score, cues), strongest first; train and flight also follow from their codes
DOCUMENT_TYPES = (
    ("train_ticket", 0.92, ("pnr", "irctc", "railway", "train", "coach", "berth")),
    ("flight_ticket", 0.88, ("boarding pass", "flight", "airline", "departure", "gate")),
    ("invoice", 0.86, ("invoice", "tax invoice", "gstin", "bill to")),
    ("hotel_booking", 0.84, ("hotel", "check-in", "check out", "room", "reservation")),
    ("receipt", 0.74, ("receipt", "total", "subtotal", "payment", "thank you")),
)

# ---- patterns ----------------------------------------------
CURRENCY_CODES = {"₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "$": "USD", "usd": "USD", "dollars": "USD", "€": "EUR", "eur": "EUR", "euros": "EUR", "£": "GBP", "gbp": "GBP", "pounds": "GBP"}
PATTERNS = {
    "email": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    "url": r"(?i)\b(?:(?:https?://|www\.)[^\s]+|[a-z0-9-]+\.(?:com|org|net|io|in|co|gov|edu)(?:/[^\s]*)?)\b",
    "phone": r"(?:\+\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?){2,4}\d{2,4}",
    "amount": r"(?i)(?:₹|\$|€|£|rs\.?|usd|inr|eur|gbp)\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?(?:rupees|dollars|euros|pounds|inr|usd|eur|gbp)",
    "time": r"(?i)\b(?:[01]?\d|2[0-3]):[0-5]\d(?:\s?[ap]\.?m\.?)?\b",
    "date_iso": r"\b\d{4}-\d{2}-\d{2}\b",
    "date_number": r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b",
    "date_text": r"(?i)\b(?:\d{1,2}\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?(?:\s+\d{1,2})?,?\s+\d{2,4}\b",
    "identifier": r"(?i)\b(?:[A-Z]{2,}[-_/]?\d{3,}[A-Z0-9-]*|#[A-Z0-9]{3,}|\d{5,})\b",
    "hashtag": r"#[A-Za-z0-9_]{2,}",
    "mention": r"(?:^|\s)(@[A-Za-z0-9_]{2,})",
    "location": r"(?i)\b(?:to|from|at|in)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)",
    "pnr": r"(?i)\b(?:pnr\s*[:#-]?\s*)?([A-Z0-9]{10})\b",
    "train_number": r"(?i)\b(?:train\s*(?:no|number)?\s*[:#-]?\s*)?(\d{5})\b",
    "flight_number": r"(?i)\b([A-Z]{2}\s?\d{3,4})\b",
    "booking_id": r"(?i)\b(?:booking|reservation|confirmation)\s*(?:id|no|number|ref)?\s*[:#-]?\s*([A-Z0-9-]{5,})\b",
    "invoice_id": r"(?i)\b(?:invoice|bill)\s*(?:id|no|number)?\s*[:#-]?\s*([A-Z0-9-]{4,})\b",
    "route": r"(?i)\bfrom\s+([A-Za-z][A-Za-z .'-]{1,40}?)\s+(?:to|[-–])\s+([A-Za-z][A-Za-z .'-]{1,40}?)(?:\s{2,}|\n|$)",
    "query_identifier": r"(?i)\b(?:[A-Z]{2,}[-_/ ]?\d{2,}[A-Z0-9-]*|\d{4,}|#[A-Z0-9]{3,})\b",
    "query_amount": r"(?i)(?:(?:₹|\$|€|£|rs\.?|usd|inr|eur|gbp)\s?\d|(?:\d[\d,]*\.?\d*)\s?(?:₹|\$|€|£|rupees|dollars|euros))",
}
ENTITY_CONFIDENCE = {"pnr": 0.95, "train_number": 0.72, "flight_number": 0.82, "booking_id": 0.84, "invoice_id": 0.88, "origin": 0.65, "destination": 0.65, "date": 0.65, "amount": 0.75}
CAPS = {"amounts": 20, "dates": 20, "times": 20, "identifiers": 30, "locations": 10, "entities": 40}

# ---- queue -----------------------------------------------------------------------------------------------------------
STAGE_PRIORITY = {"visual": 10, "text_embedding": 20, "analysis": 30, "visual_tagging": 40, "recategorize": 45, "visual_regions": 50, "visual_region_tagging": 60}
OTHER_PRIORITY = 90
ALWAYS_STAGES = ("visual", "visual_regions", "recategorize", "visual_tagging", "visual_region_tagging")
MAX_ATTEMPTS = {"index": 3, "visual": 2, "analysis": 2}
OTHER_ATTEMPTS = 3
