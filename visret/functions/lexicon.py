"""Word lists that queries are parsed with. A lexicon is a parameter; DEFAULT is for clothes."""

from dataclasses import dataclass, field

# The words and phrases that a query's facets are made of, in order of precedence.
COLORS = (
    "black", "white", "red", "blue", "yellow", "green", "orange", "purple", "pink", "brown", "grey",
    "gray", "beige", "navy", "maroon", "teal", "gold", "silver", "cream", "khaki", "olive", "turquoise",
)
INTENSIFIERS = ("bright", "dark", "light", "pale", "deep", "vivid", "neon", "pastel")
GARMENTS = (
    "raincoat", "button-down shirt", "button down shirt", "button-down", "blazer", "hoodie", "t-shirt", "tee",
    "shirt", "tie", "jacket", "coat", "trench coat", "sweater", "cardigan", "dress", "skirt", "trousers", "pants",
    "jeans", "shorts", "suit", "vest", "waistcoat", "top", "blouse", "scarf", "hat", "shoes", "boots",
)
SCENES = {
    "modern office": ("modern office", "office interior", "inside an office", "in an office", "workplace"),
    "urban street": ("urban street", "city street", "city walk", "downtown", "sidewalk"),
    "park": ("park", "park bench", "garden", "green space"),
    "home": ("home", "living room", "bedroom", "indoors at home"),
    "formal setting": ("formal setting", "formal event", "business setting"),
}
STYLES = {
    "professional business attire": ("professional", "business attire", "office wear", "corporate"),
    "casual weekend outfit": ("casual", "weekend outfit", "relaxed", "laid-back"),
    "formal outfit": ("formal", "elegant", "black tie"),
    "outerwear": ("outerwear", "cold weather outfit", "layered"),
}
ACTIONS = ("sitting", "standing", "walking", "running", "posing", "cycling")
CONFUSABLE = {
    "raincoat": ("shirt", "dress", "skirt", "pants", "jacket"),
    "coat": ("shirt", "dress", "skirt", "pants"),
    "jacket": ("shirt", "dress", "skirt", "pants"),
    "tie": ("shirt", "pants", "jacket", "dress"),
    "shirt": ("pants", "skirt", "jacket", "dress"),
    "t-shirt": ("pants", "skirt", "jacket", "dress"),
    "blouse": ("pants", "skirt", "jacket", "dress"),
    "pants": ("shirt", "jacket", "dress", "skirt"),
    "trousers": ("shirt", "jacket", "dress", "skirt"),
    "skirt": ("shirt", "jacket", "dress", "pants"),
    "dress": ("shirt", "jacket", "skirt", "pants"),
}
OTHERWISE = ("shirt", "pants", "dress", "jacket")
#: Prompts of each kind of facet; {} is the facet.
PROMPTS = {
    "binding": ("a photo of a person wearing {}", "fashion outfit with {}", "{}"),
    "scene": ("a person in {}", "fashion photo in {}", "{}"),
    "style": ("a person wearing {}", "fashion photo of {}", "{}"),
    "action": ("a person {}", "fashion photo of someone {}"),
    "garment": ("a person wearing a {}", "a fashion photo of a {}", "{}"),
    "negative": ("{}", "a person wearing {}"),
    "full": ("{}", "a fashion photo of {}"),
}


@dataclass(frozen=True)
class Lexicon:
    colors: tuple[str, ...] = COLORS
    intensifiers: tuple[str, ...] = INTENSIFIERS
    garments: tuple[str, ...] = GARMENTS
    scenes: dict[str, tuple[str, ...]] = field(default_factory=lambda: SCENES)
    styles: dict[str, tuple[str, ...]] = field(default_factory=lambda: STYLES)
    actions: tuple[str, ...] = ACTIONS
    confusable: dict[str, tuple[str, ...]] = field(default_factory=lambda: CONFUSABLE)
    otherwise: tuple[str, ...] = OTHERWISE

    @property
    def longest_first(self) -> list[str]:
        return sorted(self.garments, key=lambda g: -len(g))


DEFAULT = Lexicon()
