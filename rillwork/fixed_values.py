"""Code tables, value sets, transition tables, prices and palettes.

These must equal the published conventions for results to agree; they hold no logic.
"""

from __future__ import annotations

# --- source layers -------------------------------------------------------------
FLOWLINE_LAYERS = ("NHDFlowline",)
WATERBODY_LAYERS = ("NHDWaterbody", "NHDArea")
POINT_LAYERS = ("NHDPoint",)
LINE_LAYERS = ("NHDLine",)

# --- feature type codes ---------------------------------------------------------
CHANNEL_CLASS = {460: "stream", 336: "canal_ditch", 428: "pipeline", 558: "artificial_path",
                 334: "connector", 566: "coastline"}
CHANNEL_DASHES = {"canal_ditch": "8,4", "pipeline": "2,4", "artificial_path": "6,3,2,3"}

WATERBODY_POLICY = "2026-07-29.1"
WATERBODY_CLASS = {390: "lake", 436: "reservoir", 493: "coastal", 312: "bay", 445: "excluded",
                   460: "excluded", 466: "excluded", 361: "excluded", 378: "excluded", 336: "excluded"}
WATERBODY_LABEL = {390: "LakePond", 436: "Reservoir", 493: "Estuary", 312: "BayInlet", 445: "SeaOcean",
                   460: "StreamRiver", 466: "SwampMarsh", 361: "Playa", 378: "IceMass", 336: "CanalDitch"}
COASTAL_CLASSES = ("bay", "inlet", "coastal")

AREAL_POLICY = "2026-09-01.1"
AREAL_CLASS = {466: "wetland", 361: "playa", 378: "perennial_ice"}
AREAL_LABEL = {466: "SwampMarsh", 361: "Playa", 378: "IceMass"}

POINT_POLICY = "2026-09-01.1"
POINT_CLASS = {458: "spring", 487: "waterfall", 431: "rapids", 488: "excluded", 450: "excluded"}
POINT_LABEL = {458: "Spring/Seep", 487: "Waterfall", 431: "Rapids", 488: "Well", 450: "Sink/Rise",
               441: "Rock", 367: "Gaging Station", 369: "Gate", 436: "Reservoir", 485: "Water Intake/Outflow"}

STRUCTURE_POLICY = "2026-09-03.1"
STRUCTURE_CLASS = {343: "dam_weir", 369: "gate", 398: "lock_chamber", 367: "gaging_station",
                   485: "water_intake_outflow", 455: "spillway", 336: "canal_ditch"}
STRUCTURE_LABEL = {343: "DamWeir", 369: "Gate", 398: "LockChamber", 367: "Gaging Station",
                   485: "Water Intake/Outflow", 455: "Spillway", 336: "CanalDitch", 436: "Reservoir"}

# --- order and catalog life cycles ------------------------------------------------
ORDER_STATUSES = ("submitted", "accepted", "rendering", "proof_ready", "approved", "fulfilled",
                  "revision_requested", "render_failed", "payment_pending", "paid")
ORDER_TRANSITIONS = {
    "submitted": frozenset({"accepted"}),
    "accepted": frozenset({"rendering"}),
    "rendering": frozenset({"proof_ready", "render_failed"}),
    "proof_ready": frozenset({"approved", "revision_requested"}),
    "revision_requested": frozenset({"rendering"}),
    "approved": frozenset({"payment_pending", "fulfilled"}),
    "render_failed": frozenset({"rendering"}),
    "fulfilled": frozenset(),
    "payment_pending": frozenset({"paid"}),
    "paid": frozenset({"fulfilled"}),
}
CATALOG_STATUSES = ("draft", "review", "published", "archived", "rejected")
CATALOG_TRANSITIONS = {
    "draft": frozenset({"review", "rejected"}),
    "review": frozenset({"published", "rejected"}),
    "published": frozenset({"archived"}),
    "archived": frozenset({"published"}),
    "rejected": frozenset(),
}
DEFAULT_SECTIONS = (
    ("featured", "Featured", 0, "Our best work, front and center."),
    ("by-region", "By Region", 10, "Explore river art by state."),
    ("seasonal", "Seasonal", 20, "Seasonal and time-limited editions."),
    ("limited-edition", "Limited Edition", 30, "Exclusive numbered runs."),
)

# --- ledger value sets and id formats -----------------------------------------------
ASSET_ROLES = ("source_reference", "recipe", "run_log", "proof", "final", "print", "vector", "report",
               "figure", "animation", "thumbnail", "bundle", "license", "customer_reference")
VISIBILITY = ("internal", "approved_public")
RIGHTS = ("pending", "cleared", "restricted")
REQUEST_ID = r"^REQ-\d{8}-\d{4}$"
ORDER_ID = r"^ORD-\d{8}-\d{4}$"
ASSET_ID = r"^AST-ORD-\d{8}-\d{4}-[a-z][a-z_]*-r\d+$"
DELIVERY_ID = r"^DLV-ORD-\d{8}-\d{4}-\d+$"
ZIP_CODE = r"^\d{5}(-\d{4})?$"
KIND_ROLE = {"print": "print", "vector": "vector", "license": "license", "final": "final",
             "proof": "proof", "report": "report", "figure": "figure"}
MEDIA_TYPE = {"png": "image/png", "pdf": "application/pdf", "svg": "image/svg+xml", "jpg": "image/jpeg",
              "jpeg": "image/jpeg", "tiff": "image/tiff", "txt": "text/plain"}

# --- products ------------------------------------------------------------------------
ORDER_STYLES = ("neon-basin", "elevation-tint", "cream-basin", "museum-specimen", "museum-compass",
                "museum-almanac", "museum-divide", "museum-index")
SIZES = {"12x16": (12, 16, 300), "18x24": (18, 24, 300), "24x36": (24, 36, 300)}
PRINT_FORMATS = ("png", "pdf")
ADD_ONS = ("svg", "commercial_license")
PRINT_COST = {"12x16": 2500, "18x24": 3500, "24x36": 5500}
PRINT_COST_DEFAULT = 3500
PAPER_SURCHARGE = {"matte": 0, "glossy": 500, "canvas": 1500}
TITLE_MAX, SUBTITLE_MAX, BUYER_REF_MAX = 60, 80, 120
DEFAULT_SOURCES = (("USGS NHDPlus HR", None), ("USGS NHD", None), ("USGS WBD", None))
ENDPOINTS = {
    "digital_image": ("digital", (("svg", "vector"), ("png", "raster"))),
    "animation": ("motion", (("gif", "motion"), ("mp4", "motion"))),
    "print_image": ("print", (("png", "raster"), ("pdf", "raster"), ("tiff", "raster"))),
    "report": ("report", (("html", "document"), ("png", "figures"), ("ipynb", "notebook"), ("pdf", "document"))),
}
STATES = (
    "Maine", "New Hampshire", "Vermont", "Massachusetts", "Rhode Island", "Connecticut", "New York",
    "New Jersey", "Pennsylvania", "Delaware", "Maryland", "Virginia", "West Virginia", "North Carolina",
    "South Carolina", "Georgia", "Florida", "Alabama", "Mississippi", "Tennessee", "Kentucky", "Ohio",
    "Indiana", "Illinois", "Michigan", "Wisconsin", "Minnesota", "Iowa", "Missouri", "Arkansas",
    "Louisiana", "North Dakota", "South Dakota", "Nebraska", "Kansas", "Oklahoma", "Texas", "Montana",
    "Idaho", "Wyoming", "Nevada", "Utah", "Colorado", "Arizona", "New Mexico", "Oregon", "Washington",
    "California", "Hawaii", "Alaska",
)
NON_CONTIGUOUS = ("Hawaii", "Alaska")

# --- colours ---------------------------------------------------------------------------
PALETTES = {
    "neon": ("#00ffff", "#0a5cff", "#4b0082", "#9d00ff", "#8f00ff", "#ff00ff", "#ff7a00", "#ffd700",
             "#aaff00", "#00ffab", "#00e0d1", "#00ff5f"),
    "cream": ("#6b4226", "#8b5e3c", "#a0522d", "#7b6348", "#5c4033", "#946b4a", "#4a3728", "#b8860b",
              "#7a6652", "#8b7355", "#6e5c3b", "#a67b5b"),
}
HYPSO_LOW, HYPSO_HIGH = (26, 72, 156), (255, 255, 255)

# --- water facilities --------------------------------------------------------------------
MEASURE_TYPES = ("withdrawal", "delivered", "consumed", "discharged", "authorized_capacity")
QUANTITY_STATUSES = ("measured", "reported", "authorized", "unavailable")
EVIDENCE_RANK = {"metered_volume": 1, "withdrawal_permit": 2, "other_permit": 3,
                 "capacity_agreement": 4, "operator_disclosure": 5}
CLAIM_PUBLIC = ("publishable_precise", "publishable_generalized")
