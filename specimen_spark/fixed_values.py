"""Fixed values that results depend on.

Everything below is a constant of the data model (word lists, boxes, limits,
patterns). They are kept together so that a change of one value is one edit.
"""

# Words that never count as a species epithet.
NON_SPECIES_WORDS = (
    "aff", "aff.", "cf", "cf.", "complex", "group", "indet", "nr", "nr.",
    "sp", "sp.", "spp", "spp.", "unknown",
)

# Lower-case names of the states in scope.
US_STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado",
    "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana",
    "maine", "maryland", "massachusetts", "michigan", "minnesota",
    "mississippi", "missouri", "montana", "nebraska", "nevada",
    "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon",
    "pennsylvania", "rhode island", "south carolina", "south dakota",
    "tennessee", "texas", "utah", "vermont", "virginia", "washington",
    "west virginia", "wisconsin", "wyoming", "district of columbia",
)

# Spellings of the country in scope (after lower-casing).
US_COUNTRY_SPELLINGS = ("usa", "us", "u.s.a.", "u.s.")
US_COUNTRY = "United States"

# Region boxes (name, lat min, lat max, lon min, lon max),
# inclusive, tried in this order.
REGION_BOXES = (
    ("continental_us", 24.0, 49.8, -125.5, -66.0),
    ("alaska", 51.0, 72.5, -180.0, -129.0),
    ("alaska_dateline", 51.0, 72.5, 170.0, 180.0),
    ("hawaii", 18.5, 22.8, -161.0, -154.0),
)

# Box of the lookup service (lat min, lat max, lon min, lon max).
SERVICE_BOX = (24.5, 49.5, -125.0, -66.5)

# Bounds used to scale coordinates to [0, 1]
# (lat min, lat max, lon min, lon max).
NORMALIZE_BOUNDS = (18.5, 72.5, -180.0, -66.0)

# The family kept by cleaning.
TARGET_FAMILY = "Nymphalidae"

# File endings of images, long and short form.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".bmp", ".gif")
SIMPLE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
DEFAULT_SUFFIX = ".jpg"

# Media types and bare formats of archive rows that are images.
ARCHIVE_IMAGE_TYPES = ("image", "stillimage")
ARCHIVE_IMAGE_FORMATS = ("jpeg", "jpg", "png", "tiff", "tif", "webp", "gif", "bmp")

# Substrings of an acceptable licence (after lower-casing).
ALLOWED_LICENSES = (
    "cc0", "cc-by", "cc by", "cc-by-sa", "cc by-sa",
    "creativecommons.org/licenses/by", "creativecommons.org/publicdomain/zero",
)

# Patterns of each view family, searched in lower-case text.
VIEW_PATTERNS = {
    "dorsal": (
        r"(?<![a-z])dorsal(?![a-z])",
        r"(?<![a-z])upperside(?![a-z])",
        r"(?<![a-z])upper_side(?![a-z])",
        r"(?<![a-z])upper-side(?![a-z])",
        r"(?<![a-z])top(?![a-z])",
        r"[_-]d(?:[_-]|$)",
    ),
    "ventral": (
        r"(?<![a-z])ventral(?![a-z])",
        r"(?<![a-z])underside(?![a-z])",
        r"(?<![a-z])under_side(?![a-z])",
        r"(?<![a-z])under-side(?![a-z])",
        r"(?<![a-z])bottom(?![a-z])",
        r"[_-]v(?:[_-]|$)",
    ),
    "lateral": (
        r"(?<![a-z])lateral(?![a-z])",
        r"(?<![a-z])side(?![a-z])",
        r"(?<![a-z])profile(?![a-z])",
    ),
}

# Record page addresses and the archive source name.
OCCURRENCE_SOURCE = "gbif"
SPECIMEN_SOURCE = "idigbio"
ARCHIVE_SOURCE = "idigbio_dwca"
OCCURRENCE_RECORD_URL = "https://www.gbif.org/occurrence/"
SPECIMEN_RECORD_URL = "https://search.idigbio.org/v2/view/records/"

# What a nearest-record lookup answers when nothing is found.
NEAREST_FALLBACK_SPECIES = "Mock Fallback"
NEAREST_FALLBACK_URL = (
    "https://upload.wikimedia.org/wikipedia/commons/thumb/3/3d/"
    "Flickr_-_ggallice_-_Morpho_peleides.jpg/640px-Flickr_-_ggallice_-_Morpho_peleides.jpg"
)

# Statuses.
DOWNLOADED_STATUSES = ("downloaded", "exists")
RECOVERED_CROP = "recovered_from_existing_output"
FALLBACK_CROP = "fallback_center_crop"

# Upper ends (exclusive) of the class-frequency bands.
FREQUENCY_BANDS = (("rare", 10), ("tail", 30), ("medium", 100), ("common", None))
