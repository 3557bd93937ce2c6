"""Reference data of the engine: small fixed tables, and those a caller provides."""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values: how far each kind of source is trusted
RELIABILITY = {
    "official_website": 0.95, "government": 0.95, "professional_association": 0.9, "google_maps": 0.88, "serper_places": 0.86, "serper_search": 0.62,
    "tavily_search": 0.68, "geoapify": 0.78, "healthcare_directory": 0.82, "legal_directory": 0.82, "business_directory": 0.75, "review_platform": 0.72,
    "social_profile": 0.62, "search_result": 0.45, "unknown": 0.4, "content_lead": 0.36,
}

# fixed values: parts of host names and the kind of source they tell; the first that fits decides
HOST_HINTS = (
    ("yelp.", "review_platform"), ("yellowpages.", "business_directory"), ("healthgrades.", "healthcare_directory"), ("zocdoc.", "healthcare_directory"),
    ("webmd.", "healthcare_directory"), ("doximity.", "healthcare_directory"), ("avvo.", "legal_directory"), ("justia.", "legal_directory"),
    ("findlaw.", "legal_directory"), ("bbb.", "business_directory"), ("linkedin.", "social_profile"), ("facebook.", "social_profile"),
    ("instagram.", "social_profile"), ("justdial.", "business_directory"), ("sulekha.", "business_directory"), ("indiamart.", "business_directory"),
    ("cybo.", "business_directory"), ("yappe.", "business_directory"), ("webindia123.", "business_directory"), ("cylex.", "business_directory"),
    ("hotfrog.", "business_directory"), ("tripadvisor.", "review_platform"), ("zomato.", "review_platform"), ("restaurant-guru.", "review_platform"),
    ("magicpin.", "review_platform"), ("dineout.", "review_platform"), ("quora.", "content_lead"), ("reddit.", "content_lead"), (".gov", "government"), (".us", "government"),
)

# fixed values: industries and the words that tell them, in the order they are tried
INDUSTRIES = (
    ("healthcare", ("doctor", "cardiologist", "dentist", "clinic", "physician", "pediatrician", "dermatologist", "orthopedic", "surgeon")),
    ("legal", ("lawyer", "attorney", "law firm", "family law", "personal injury", "criminal defense")),
    ("trades", ("plumber", "roofing", "roofer", "electrician", "contractor", "hvac", "landscaping")),
    ("food_hospitality", ("restaurant", "cafe", "hotel", "bakery", "food", "dining", "eatery")),
    ("retail", ("shop", "store", "shopping", "showroom", "supermarket", "mall", "retail")),
    ("wellness", ("salon", "spa", "gym", "fitness", "beauty parlour")),
    ("education", ("school", "college", "training", "institute", "academy")),
)

# fixed values: groups of planned queries in the order in which a budget is shared out
GROUP_ORDER = ("places", "contact", "directory", "industry_directory", "official", "review", "services", "regulated", "social", "lead_article")

# fixed values: fields of an entity
SCALAR_FIELDS = ("business_name", "address", "phone", "email", "website", "working_hours", "rating", "review_count", "license_information")
LIST_FIELDS = ("services", "specialties", "certifications", "awards", "social_profiles", "images_urls")

COUNTRY_NAMES = {"in": "India", "us": "United States", "gb": "United Kingdom", "ca": "Canada", "ae": "United Arab Emirates"}


@dataclass(frozen=True)
class Gazetteer:
    """Places and categories a deployment knows. The defaults are a small sample; load your own tables."""

    corrections: dict[str, str] = field(default_factory=lambda: {"usa": "united states", "uk": "united kingdom", "uae": "united arab emirates", "trichy": "tiruchirappalli", "tamilnadu": "tamil nadu", "westbengal": "west bengal"})
    aliases: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"chennai": ("chennai", "madras", "chennai tamil nadu", "tamil nadu"), "austin": ("austin", "austin texas", "texas"), "london": ("london", "london uk", "united kingdom", "england"), "toronto": ("toronto", "toronto ontario", "ontario", "canada")})
    regions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"tamil nadu": ("chennai", "coimbatore", "madurai", "salem"), "texas": ("austin", "dallas", "houston"), "ontario": ("toronto", "ottawa"), "england": ("london", "leeds")})
    countries: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
        ("in", ("india", "bharat"), ("tamil nadu",)),
        ("us", ("united states", "usa"), ("texas",)),
        ("gb", ("united kingdom", "uk", "england"), ("england",)),
        ("ca", ("canada",), ("ontario",)),
        ("ae", ("united arab emirates", "uae"), ()),
    )
    expansions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"dentists": ("dentist", "dental clinic", "orthodontist"), "plumbers": ("plumber", "plumbing service", "pipe repair"), "cafes": ("cafe", "coffee shop", "bakery cafe"), "gyms": ("gym", "fitness centre", "health club")})
    category_corrections: dict[str, str] = field(default_factory=lambda: {"plumers": "plumbers", "resturants": "restaurants", "electritian": "electricians"})
    taxonomy: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"dentist": ("healthcare.dentist",), "cafe": ("catering.cafe",), "gym": ("sport.fitness",), "plumber": ("service", "commercial")})
    off_places: tuple[str, ...] = ("gujarat", "sydney", "paris")
