"""The vocabularies of scene tags, and the weights and suffixes of rooms."""

MESH_TYPES = ("room", "object", "cutter")
ROOM_TYPES = (
    "kitchen", "bedroom", "living-room", "closet", "hallway", "bathroom", "garage", "balcony", "dining-room", "utility",
    "staircase-room", "warehouse", "office", "meeting-room", "open-office", "break-room", "restroom", "factory-office",
)
OBJECT_TYPES = ("furniture", "FloorMat", "wall-decoration", "handheld-item")
FURNITURE_FUNCTIONS = (
    "storage", "seating", "lounge-seating", "table", "bathing", "side-table", "watchable", "desk", "bed", "sink",
    "ceiling-light", "lighting", "kitchen-counter", "kitchen-appliance",
)
SMALL_OBJECT_FUNCTIONS = (
    "table-display-item", "office-shelf-item", "kitchen-counter-item", "food-pantry", "bathroom-item", "shelf-trinket",
    "dishware", "cookware", "utensils", "cloth-drape",
)
OBJECT_ACCESS_TYPE = ("access-top", "access-front", "access-any-side", "access-all-sides")
OBJECT_ACCESS_METHOD = ("access-stand-near", "access-open-door", "access-with-hand")
CUTTER_TYPES = ("chair", "window", "open", "entrance", "door")
CONNECTOR_TYPES = ("door", "open", "wall")
PLAIN_RELATIONS = ("AnyRelation", "IdentityCompareRelation", "CutFrom", "SharedEdge", "Traverse")
GEOMETRY_RELATIONS = ("GeometryRelation", "Touching", "SupportedBy", "CoPlanar")
ROOM_WEIGHT = {
    "living-room": 2.0, "kitchen": 1.5, "dining-room": 1.5, "bedroom": 1.2, "office": 1.2, "bathroom": 0.6, "closet": 0.4,
    "balcony": 0.6, "hallway": 1.0,
}
ROOM_SUFFIXES = ("_floor", "_wall", "_ceiling", "_exterior", "")
SKIP_SEMANTICS = ROOM_TYPES + (
    "room", "cutter", "door", "window", "entrance", "open", "root", "room-node", "room-contour", "ground", "second-floor",
    "third-floor", "exterior", "staircase", "visited", "new", "ceiling-light", "lighting", "wall-decoration",
)
META_SKIP = (
    "object", "real-placeholder", "oversize-placeholder", "asset-as-placeholder", "asset-placeholder-for-children",
    "placeholder-bbox", "single-generator", "no-rotation", "no-collision", "no-children", "access-top", "access-front",
    "access-any-side", "access-all-sides", "access-stand-near", "access-open-door", "access-with-hand",
)
