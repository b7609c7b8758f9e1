"""Spanish names for colours, materials and shelves.

Small closed glossaries, so they are literal maps inside the projection: no join
and no shuffle. A word outside a glossary keeps its original spelling; an unknown
shelf adds no search terms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import casefold

# Colour names, English to Spanish.
COLOURS = {
    "amber": "Ámbar",
    "beige": "Beige",
    "black": "Negro",
    "blue": "Azul",
    "blush": "Rosa Empolvado",
    "brass": "Latón",
    "brown": "Marrón",
    "burgundy": "Burdeos",
    "chalk": "Blanco Tiza",
    "charcoal": "Carbón",
    "check": "A Cuadros",
    "chrome": "Cromado",
    "clay": "Arcilla",
    "clear": "Transparente",
    "copper": "Cobre",
    "cream": "Crema",
    "forest": "Verde Bosque",
    "gold": "Dorado",
    "graphite": "Grafito",
    "green": "Verde",
    "grey": "Gris",
    "gunmetal": "Gris Metálico",
    "indigo": "Índigo",
    "ivory": "Marfil",
    "midnight": "Azul Medianoche",
    "mint": "Menta",
    "mixed": "Combinado",
    "multi": "Multicolor",
    "natural": "Natural",
    "navy": "Azul Marino",
    "oak": "Roble",
    "oatmeal": "Beige Avena",
    "off white": "Blanco Roto",
    "olive": "Verde Oliva",
    "pearl": "Perla",
    "red": "Rojo",
    "sage": "Verde Salvia",
    "sand": "Arena",
    "silver": "Plateado",
    "slate": "Gris Pizarra",
    "speckled grey": "Gris Moteado",
    "steel": "Gris Acero",
    "tan": "Beige Tostado",
    "teal": "Verde Azulado",
    "terracotta": "Terracota",
    "walnut": "Nogal",
    "warm white": "Blanco Cálido",
    "white": "Blanco",
    "yellow": "Amarillo",
}

# Material words, English to Spanish.
MATERIALS = {
    "100gsm paper": "papel de 100 g/m²",
    "22 momme silk": "seda de 22 momme",
    "90gsm paper": "papel de 90 g/m²",
    "abs": "ABS",
    "aluminium": "aluminio",
    "aluminium tube": "tubo de aluminio",
    "baby alpaca": "alpaca bebé",
    "beech": "haya",
    "birch ply": "contrachapado de abedul",
    "board": "cartón",
    "borosilicate glass": "vidrio de borosilicato",
    "brass": "latón",
    "canvas": "lona",
    "carbon steel": "acero al carbono",
    "card": "cartulina",
    "ceramic": "cerámica",
    "cloth": "tela",
    "copper": "cobre",
    "cord": "cordón",
    "cork": "corcho",
    "cotton": "algodón",
    "cotton paper": "papel de algodón",
    "cotton rope": "cuerda de algodón",
    "enamelled cast iron": "hierro fundido esmaltado",
    "enamelled steel": "acero esmaltado",
    "eva foam": "espuma EVA",
    "fabric": "tela",
    "felt": "fieltro",
    "film": "película",
    "foam": "espuma",
    "freshwater pearl": "perla de agua dulce",
    "full-grain leather": "cuero de flor entera",
    "glass": "vidrio",
    "glass beads": "cuentas de vidrio",
    "glass jar": "tarro de vidrio",
    "gold vermeil": "vermeil de oro",
    "gold vermeil on silver": "vermeil de oro sobre plata",
    "ink": "tinta",
    "jute": "yute",
    "latex": "látex",
    "lead-free crystal": "cristal sin plomo",
    "leather": "cuero",
    "linen": "lino",
    "linen shade": "pantalla de lino",
    "linen thread": "hilo de lino",
    "maple": "arce",
    "marble": "mármol",
    "mdf": "MDF",
    "memory foam": "espuma viscoelástica",
    "oak": "roble",
    "olive wood": "madera de olivo",
    "organic cotton": "algodón orgánico",
    "pakkawood": "pakkawood",
    "paper": "papel",
    "pbt": "PBT",
    "plastic": "plástico",
    "plush": "peluche",
    "plywood": "contrachapado",
    "protein leather": "cuero de proteína",
    "pu backing": "refuerzo de PU",
    "pu leather": "cuero sintético (PU)",
    "rattan": "ratán",
    "recycled fabric": "tela reciclada",
    "recycled nylon": "nailon reciclado",
    "recycled plastic": "plástico reciclado",
    "resin": "resina",
    "ripstop nylon": "nailon ripstop",
    "rubber": "caucho",
    "seagrass": "fibra de alga marina",
    "seed": "semilla",
    "sheepskin": "piel de oveja",
    "silicone": "silicona",
    "silk": "seda",
    "silver": "plata",
    "sisal": "sisal",
    "slate": "pizarra",
    "soap": "jabón",
    "solid oak": "roble macizo",
    "soy wax": "cera de soja",
    "stainless steel": "acero inoxidable",
    "steel": "acero",
    "steel mesh": "malla de acero",
    "steel nib": "plumín de acero",
    "sterling silver": "plata de ley",
    "stoneware": "gres",
    "tea": "té",
    "terracotta": "terracota",
    "terrazzo": "terrazo",
    "tin": "estaño",
    "titanium": "titanio",
    "turkish cotton": "algodón turco",
    "vg-10 steel": "acero VG-10",
    "walnut": "nogal",
    "walnut box": "caja de nogal",
    "walnut veneer": "chapa de nogal",
    "washed linen": "lino lavado",
    "water-based paint": "pintura al agua",
    "wax": "cera",
    "waxed canvas": "lona encerada",
    "wood": "madera",
    "wool": "lana",
    "wool blend": "mezcla de lana",
    "zirconia": "circonia",
}

# Search words for categories and subcategories, English to Spanish.
SHELF_TERMS = {
    "beauty & wellness": "belleza bienestar",
    "books & stationery": "libros papelería",
    "experiences": "experiencias",
    "games & puzzles": "juegos rompecabezas",
    "home & living": "hogar casa",
    "jewellery": "joyería",
    "kids": "niños infantil",
    "kitchen & dining": "cocina comedor",
    "outdoor & travel": "aire libre viaje",
    "pets": "mascotas",
    "tech & gadgets": "tecnología gadgets",
    "audio": "audio altavoces auriculares",
    "bags": "bolsos mochilas",
    "bar": "coctelería bar",
    "bath": "baño",
    "board games": "juegos de mesa",
    "books": "libros",
    "bracelets": "pulseras",
    "candles": "velas",
    "cats": "gatos",
    "classic games": "juegos clásicos",
    "coffee": "café",
    "cookware": "ollas sartenes utensilios",
    "craft": "manualidades",
    "creative": "creativo",
    "decor": "decoración",
    "desk": "escritorio oficina",
    "dogs": "perros",
    "drinkware": "botellas tazas vasos",
    "earrings": "pendientes",
    "fitness": "fitness ejercicio deporte",
    "fragrance": "fragancia perfume",
    "garden": "jardín",
    "gift cards": "tarjetas regalo",
    "grooming": "aseo afeitado",
    "home tech": "domótica hogar",
    "knives": "cuchillos",
    "lighting": "iluminación lámparas",
    "mobile": "móvil teléfono",
    "necklaces": "collares",
    "outdoor": "aire libre camping",
    "paper": "papel cuadernos",
    "pens": "bolígrafos plumas",
    "photo": "fotografía cámara",
    "puzzles": "rompecabezas puzzles",
    "reading": "lectura ebook",
    "recovery": "recuperación masaje",
    "rings": "anillos",
    "serving": "servir bandejas",
    "skincare": "cuidado piel facial",
    "sleep": "sueño dormir descanso",
    "storage": "almacenaje organización",
    "tableware": "vajilla",
    "tea": "té infusiones",
    "textiles": "textiles mantas",
    "toys": "juguetes",
    "vases": "jarrones",
    "watches": "relojes",
    "wearable": "wearable actividad",
}


def _lookup(names: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*[F.lit(text) for pair in names.items() for text in pair])
    return F.try_element_at(entries, key)


def translate_color(color: Column) -> Column:
    return F.coalesce(_lookup(COLOURS, casefold(color)), color)


def translate_material(material: Column) -> Column:
    """Translate each comma-separated word; only the first letter is capitalised."""
    words = F.transform(F.split(material, ","), lambda word: F.trim(word))
    translated = F.transform(
        words, lambda word: F.coalesce(_lookup(MATERIALS, casefold(word)), word)
    )
    joined = F.concat_ws(", ", translated)
    return F.when(
        material.isNotNull(),
        F.concat(F.upper(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2))),
    )


def search_terms(*labels: Column) -> Column:
    """Spanish search words of the given shelf labels, joined by spaces."""
    return F.concat_ws(" ", *[_lookup(SHELF_TERMS, casefold(label)) for label in labels])
