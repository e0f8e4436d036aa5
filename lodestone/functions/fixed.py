"""Vocabularies, templates and thresholds that results depend on, in their natural order."""

# Labels of the external source and their grades.
LABEL_GRADES = {"Exact": 3, "Substitute": 2, "Complement": 1, "Irrelevant": 0, "E": 3, "S": 2, "C": 1, "I": 0}

# Query words of Hindi, Arabic and Polish and their English.
TRANSLATIONS = {
    "जूते": "shoes",
    "इलेक्ट्रॉनिक्स": "electronics",
    "कपड़े": "clothing",
    "सोनी": "sony",
    "नाइकी": "nike",
    "أحذية": "shoes",
    "إلكترونيات": "electronics",
    "ملابس": "clothing",
    "سوني": "sony",
    "buty": "shoes",
    "elektronika": "electronics",
    "odzież": "clothing",
    "tanie": "cheap",
    "najlepszy": "best",
}

# Surface forms of categories and brands by canonical name.
CATEGORY_FORMS = {
    "shoes": ["shoes", "footwear", "sneakers", "running shoes", "trainers", "kicks", "runners"],
    "electronics": ["electronics", "gadgets", "devices", "tech", "consumer electronics"],
    "clothing": ["clothing", "apparel", "garments", "fashion", "wear"],
    "home": ["home", "household", "home goods", "interior", "domestic"],
}
BRAND_FORMS = {
    "nike": ["nike", "nik", "nike inc"],
    "sony": ["sony", "sony corp", "sony electronics"],
    "samsung": ["samsung", "samsung electronics", "samsung corp"],
    "apple": ["apple", "apple inc", "apple computer"],
}

# Product codes in a query.
SKU_PATTERNS = (r"\b[A-Z]+[-]?\d{2,}[A-Z0-9]*\b", r"\b\d{4}[A-Z]+\b")

# Words that show an intent to buy.
BUYING_WORDS = ("best", "cheap", "buy", "top", "affordable")
BUYING_WORDS_WIDE = ("best", "cheap", "buy", "top", "affordable", "price", "deal", "review", "online")

# Categories of the guardrails, and aliases of categories in serving.
PRIMARY_TRAINING = ("laptops", "phones", "electronics", "shoes", "clothing")
PRIMARY_SERVING = ("laptops", "phones", "electronics", "shoes", "footwear", "clothing", "smartphone", "mobile", "laptop")
ACCESSORIES = ("accessories", "chargers", "cases", "cables", "covers")
CATEGORY_ALIASES = {"footwear": "shoes", "sneakers": "shoes", "smartphone": "phones", "mobile": "phones", "laptop": "laptops", "notebook": "laptops"}
UNKNOWN_CATEGORIES = ("us", "es", "jp", "")

# Title words and their translations, replaced in this order, and what follows an unchanged title.
TITLE_WORDS = {
    "hi": {"Footwear": "जूते", "Electronics": "इलेक्ट्रॉनिक्स", "Clothing": "कपड़े", "Home": "घर", "Men's": "पुरुषों के लिए", "Women's": "महिलाओं के लिए", "Running": "दौड़ने", "Training": "प्रशिक्षण"},
    "ar": {"Footwear": "أحذية", "Electronics": "إلكترونيات", "Clothing": "ملابس", "Home": "منزل", "Men's": "رجالي", "Women's": "نسائي", "Running": "الجري", "Training": "التدريب"},
    "pl": {"Footwear": "obuwie", "Electronics": "elektronika", "Clothing": "odzież", "Home": "dom", "Men's": "męskie", "Women's": "damskie", "Running": "biegania", "Training": "treningu"},
}
TITLE_SUFFIX = {"hi": "हिंदी में", "ar": "بالعربية", "pl": "po polsku"}

# Product titles by category.
PRODUCT_TEMPLATES = {
    "Footwear": [
        "{brand} Air {model} — {adjective} {gender} {category}, {color}, Size {size}",
        "{brand} {model} Pro — Lightweight {gender} {category} for {activity}, {color}",
        "{brand} {model} Ultra — Cushioned {category} with {tech}, {color}, {size}",
        "{brand} {category} {model} — Breathable Mesh Upper, {color}, {width} Fit",
        "{brand} Performance {category} — {activity}-Ready, {tech} Sole, {color}",
    ],
    "Electronics": [
        "{brand} {model} — {adjective} {category} with {tech}, {color}, {storage}",
        "{brand} {model} Pro — Flagship {category}, {display} Display, {storage}",
        "{brand} {category} {model} — {tech} Processor, {color}, {storage} Storage",
        "{brand} Wireless {category} — Noise Cancelling, {battery} Battery, {color}",
        "{brand} Smart {category} — {tech} Sensor, {display} Screen, {color}",
    ],
    "Clothing": [
        "{brand} {model} — {adjective} {gender} {category}, {color}, Size {size}",
        "{brand} {category} {model} — {tech} Fabric, {color}, {fit} Fit",
        "{brand} Performance {category} — Moisture-Wicking, {color}, {size}",
        "{brand} {adjective} {category} — {tech} Material, {color}, {gender}",
        "{brand} Everyday {category} — Comfortable {fit} Fit, {color}, Size {size}",
    ],
    "Home": [
        "{brand} {model} — {adjective} {category}, {color}, {size} Dimensions",
        "{brand} Smart {category} — {tech} Enabled, {color}, {storage} Capacity",
        "{brand} Premium {category} — {tech} Material, {color}, {size}",
        "{brand} {category} {model} — Energy Efficient, {color}, {display} Controls",
        "{brand} Modern {category} — {adjective} Design, {color}, {size}",
    ],
}

# What fills the slots of titles and queries.
SLOTS = {
    "model": ["Max 270", "Ultra Boost", "Phantom", "Zoom Fly", "React", "X1000", "Pro 5", "Elite", "Studio", "Vision", "Aero", "Nova", "Prime", "Edge", "Core"],
    "adjective": ["Premium", "Breathable", "Durable", "Lightweight", "Ergonomic", "Stylish", "Comfortable", "High-Performance", "Sleek", "Versatile"],
    "gender": ["Men's", "Women's", "Unisex", "Kids'", "Youth"],
    "color": ["Triple Black", "White/Red", "Navy Blue", "Olive Green", "Charcoal Grey", "Midnight Blue", "Pearl White", "Crimson Red", "Stealth Grey", "Electric Blue"],
    "size": ["7", "8", "9", "10", "11", "12", "S", "M", "L", "XL", "XXL"],
    "width": ["Standard", "Wide", "Narrow", "Extra Wide"],
    "activity": ["Running", "Training", "Marathons", "Gym", "Casual Wear", "Sports"],
    "tech": ["Air Cushion", "Gel", "React Foam", "Memory Foam", "Carbon Fiber", "AI-Powered", "Quantum", "Neural", "Bluetooth 5.3", "Wi-Fi 6E"],
    "storage": ["128GB", "256GB", "512GB", "1TB", "64GB"],
    "display": ["OLED", "AMOLED", "Retina", "4K", "QHD", "FHD+"],
    "battery": ["24h", "36h", "48h", "72h", "All-Day"],
    "fit": ["Slim", "Regular", "Relaxed", "Athletic", "Tailored"],
}
LOCATIONS = ["India", "Egypt", "Poland", "USA", "UK"]

# Query templates by intent, then by language.
QUERY_TEMPLATES = {
    "generic": [
        "affordably priced {syn_category} for {activity}",
        "best {syn_category} under {price}",
        "top rated {syn_category} {year}",
        "where to buy {syn_category} online",
        "{syn_category} recommendations for beginners",
        "cheap {syn_category} with free shipping",
        "high quality {syn_category} reviews",
        "most comfortable {syn_category}",
        "{syn_category} for {activity} in {location}",
        "what are the best {syn_category} this year",
    ],
    "brand": [
        "{syn_brand} {syn_category} latest collection",
        "official {syn_brand} store {syn_category}",
        "{syn_brand} {syn_category} price comparison",
        "authentic {syn_brand} {syn_category} online",
        "{syn_brand} new releases {year}",
        "{syn_brand} {syn_category} warranty",
        "why choose {syn_brand} {syn_category}",
        "{syn_brand} vs competitors {syn_category}",
    ],
    "sku": [
        "{syn_brand} {model} {syn_category} specs",
        "{syn_brand} {model} price in {location}",
        "{syn_brand} {model} review and unboxing",
        "buy {syn_brand} {model} {syn_category} online",
        "{syn_brand} {model} {color} availability",
        "{syn_brand} {model} {storage} best deal",
        "latest {year} {syn_brand} {model} release date",
    ],
    "descriptive": [
        "{color} {syn_category} with {tech}",
        "{adjective} {syn_category} for {activity}",
        "{syn_category} with {tech} and {color}",
        "{gender} {syn_category} {color} size {size}",
        "{syn_category} featuring {tech} technology",
        "lightweight {syn_category} for {activity}",
        "{color} {syn_category} {adjective} design",
    ],
    "multilingual_hi": [
        "{syn_brand} {syn_category} खरीदें",
        "सस्ते {syn_category} ऑनलाइन",
        "{syn_category} रनिंग के लिए",
        "{syn_brand} {model} कीमत",
        "बेहतरीन {syn_category} {year}",
    ],
    "multilingual_ar": [
        "شراء {syn_brand} {syn_category}",
        "أفضل {syn_category} بسعر رخيص",
        "{syn_category} للجري",
        "سعر {syn_brand} {model}",
        "{syn_category} عالي الجودة",
    ],
    "multilingual_pl": [
        "kup {syn_brand} {syn_category}",
        "tanie {syn_category} online",
        "{syn_category} do biegania",
        "cena {syn_brand} {model}",
        "najlepsze {syn_category} {year}",
    ],
    "multilingual_en": [
        "buy {syn_brand} {syn_category}",
        "{syn_category} for {activity}",
        "{syn_brand} {model} price",
        "best {syn_category} {year}",
        "{color} {syn_category} with {tech}",
    ],
}

# Near misses of a product, with their kind.
HARD_NEGATIVES = [
    ("wrong_model", "{brand} {wrong_model} {category}"),
    ("wrong_brand", "{wrong_brand} {model} {category}"),
    ("old_generation", "{brand} {model} {prev_year} {category}"),
    ("wrong_variant", "{brand} {model} {wrong_color} {category} size {wrong_size}"),
    ("accessory_not_product", "{brand} {category} accessories for {model}"),
    ("competitor", "{wrong_brand} equivalent to {brand} {model}"),
]

# The plain templates of a product's queries (language, template).
PLAIN_QUERIES = [("en", "{brand} {category}"), ("en", "best {category}"), ("hi", "{brand} {category}"), ("en", "irrelevant query"), ("ar", "cheap {brand} {category}")]

# The columns of a feature vector.
FEATURES = (
    "semantic_sim", "cross_lingual_sim", "bm25_score", "jaccard", "brand_match", "category_match", "exact_title_match",
    "query_len", "intent_brand_weight", "intent_sku_weight", "intent_generic_weight", "semantic_channel", "lexical_channel", "constraint_channel",
)
