"""Activity names to trade, zone and phase by ordered rules; the first that matches wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CONCRETE, STEEL, MASONRY, ROOF, GLASS, WATER = "Concrete", "Structural Steel", "Masonry", "Roofing", "Aluminum & Glass", "Waterproofing"
CARPENTRY, PIPES, WIRES, LOW, FIRE = "Rough Carpentry, Drywall, Ceilings", "Plumbing & H.V.A.C", "Electrical & Fire Alarm", "Low Voltage", "Fire Protection"
SITE, GREEN, GENERAL, DEMOLITION = "Sitework", "Landscaping", "General Requirements", "Site Demolition"

#: Pattern, trade, further trades, cost weight, intensity; in order of precedence.
TRADES: tuple[tuple[str, str, tuple[str, ...], float, float], ...] = (
    ("FTG|FTGS|FOOTING", CONCRETE, (), 1.0, 1.5), ("SOG|SLAB", CONCRETE, (), 1.0, 1.4), ("POUR.*DECK|DECK.*POUR", CONCRETE, (STEEL,), 0.7, 1.5),
    ("REBAR|WIRE", CONCRETE, (), 1.0, 1.2), ("GB|GRADE BEAM", CONCRETE, (), 1.0, 1.3), ("PIER", CONCRETE, (), 1.0, 1.3),
    ("ERECT.*STEEL|STEEL|STRUCT.*STEEL", STEEL, (), 1.0, 1.4), ("METAL DECK|MTL DECK", STEEL, (), 1.0, 1.2), ("NELSON STUD|WELD.*STUD", STEEL, (), 1.0, 1.1), ("DUNNAGE|MECH.*SCREEN", STEEL, (), 1.0, 1.0),
    ("CMU", MASONRY, (), 1.0, 1.1), ("BRICK", MASONRY, (), 1.0, 1.1), ("MASONRY", MASONRY, (), 1.0, 1.0),
    ("VAPOR.*BARRIER|ROOF.*VAPOR", ROOF, (), 1.0, 0.9), ("SKYLIGHT", ROOF, (GLASS,), 0.6, 1.3), ("PVC|INSULATION.*ROOF|MAIN ROOF", ROOF, (), 1.0, 1.2), ("GREEN ROOF", ROOF, (GREEN,), 0.85, 1.4),
    ("PARAPET|COPING", ROOF, (MASONRY,), 0.7, 1.0), ("ROOF DRAIN", PIPES, (), 1.0, 0.8),
    ("WINDOW|SF WINDOW|STOREFRONT", GLASS, (), 1.0, 1.3), ("CURTAIN WALL", GLASS, (), 1.0, 1.4),
    ("AVB|AIR.*VAPOR", WATER, (), 1.0, 0.9), ("WATERPROOF", WATER, (), 1.0, 1.0), ("FOUNDATION.*WATERPROOF", WATER, (), 1.0, 1.1),
    ("FRAME.*WALL|INT.*WALL|WALL.*FRAME", CARPENTRY, (), 1.0, 0.9), ("SHEATH", CARPENTRY, (), 1.0, 0.8), ("CEIL|CORRIDOR CEIL|CEILING", CARPENTRY, (), 1.0, 0.9),
    ("INSULATION|THERM.*INSUL|WALL INSUL", CARPENTRY, (), 0.8, 0.8), ("BLOCKING|CLOSE-IN|PUNCHLIST", CARPENTRY, (), 1.0, 0.7), ("DRYWALL", CARPENTRY, (), 1.0, 0.9),
    (r"PLUMB|U\.G\. PLUMB|UNDERGROUND PLUMB", PIPES, (), 1.0, 1.0), ("DUCT|DUCTWORK", PIPES, (), 1.0, 1.0), ("HVAC|PIPING|HVAC PIPING", PIPES, (), 1.0, 1.1), ("ACCU|DOAS|AHU", PIPES, (), 1.0, 1.3), ("ROOFTOP.*UNIT|RTU", PIPES, (), 1.0, 1.4),
    ("ELEC|ELECTRICAL|COMM RI", WIRES, (), 1.0, 1.0), ("PANEL|SWITCHGEAR", WIRES, (), 1.0, 1.2), ("TRANSFORMER", WIRES, (), 1.0, 1.3),
    ("AV|SECURITY|PULL.*CABLE", LOW, (), 1.0, 0.9), ("DATA|COMM|TELECOM", LOW, (), 1.0, 0.9),
    ("FS MAIN|FS LAT|FIRE.*MAIN|SPRINKLER", FIRE, (), 1.0, 1.0), ("STANDPIPE", FIRE, (), 1.0, 1.1),
    ("MOBILIZE", GENERAL, (SITE,), 0.7, 1.0), ("SURVEY|LOD", GENERAL, (), 1.0, 0.5), ("EXC|EXCAVAT", SITE, (CONCRETE,), 0.7, 1.1), ("DRILL.*PILE|GROUT|MICROPILE", SITE, (), 1.0, 1.3), ("LAG|SOE", SITE, (), 1.0, 1.2),
    ("TOPSOIL|GRADE|GRADING|CUT|FILL", SITE, (), 1.0, 1.0), ("COMPACT|FABRIC|STONE", SITE, (), 1.0, 0.9), ("BACKFILL", SITE, (), 1.0, 0.8), ("DRIVEWAY|TEMP DRIVE", SITE, (), 1.0, 0.9),
    ("RETAINING|BIOPLANTER", SITE, (MASONRY,), 0.5, 1.0), ("SIDEWALK|STAIR", SITE, (CONCRETE,), 0.6, 1.0), ("PLAYGROUND|PLAY STRUCTURE|PIP", SITE, (), 1.0, 1.2), ("HAND RAIL|RAILING", SITE, (), 0.6, 0.8),
    ("SHADE STRUCTURE", SITE, (), 1.0, 1.1), ("FENCE|FENCING", SITE, (), 1.0, 0.8),
    ("ROOT PRUNE|TREE.*PROTECT", GREEN, (SITE,), 0.6, 0.6), ("SOD|PLANTING|PLANT", GREEN, (), 1.0, 1.0), ("TOPSOIL.*PLACE|PLACE.*TOPSOIL", GREEN, (), 1.0, 0.9), ("MULCH", GREEN, (), 1.0, 0.7), ("IRRIGATION", GREEN, (), 1.0, 1.0),
    ("INSPECT", GENERAL, (), 1.0, 0.2), ("CURE|CURE TIME", GENERAL, (), 1.0, 0.05), ("DEMO|DEMOLITION", DEMOLITION, (), 1.0, 1.0),
)
#: Zone patterns (east first) and phases by substrings of names or prefixes of ids, in order.
EAST, WEST = (r"NORTH", r"N\.", r"N 1/2", r"1ST FL", r"EAST", r"E\."), (r"SOUTH", r"S\.", r"WS\.", r"WC\.", r"2ND FL", r"CAFETERIA", r"WEST", r"W\.")
PHASES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("MOBILIZATION", ("MOBILIZE", "SURVEY", "LOD"), ()),
    ("SITE_PREP", (), ("SITE-0", "SITE0")), ("SITE_PREP", ("TREE", "ROOT", "SOE", "LAG", "DRILL", "PILE"), ()),
    ("FOUNDATION", ("FTG", "SOG", "PIER", "BACKFILL", "GRADE BEAM", "GB"), ()),
    ("STRUCTURE", ("STEEL", "CMU", "DECK", "POUR", "FRAME", "ERECT"), ()),
    ("ENVELOPE", ("ROOF", "BRICK", "WINDOW", "AVB", "PARAPET", "CURTAIN"), ()),
    ("MEP_ROUGH", ("PLUMB", "DUCT", "ELEC", "FS", "HVAC", "PIPING", "FIRE"), ()),
    ("FINISHES", ("CEIL", "INSUL", "INSPECT", "CLOSE", "DRYWALL", "PAINT"), ()),
    ("SITE_FINISHES", (), ("SITE-2", "SITE2")), ("SITE_FINISHES", ("PLAYGROUND", "SOD", "PLANT", "SIDEWALK", "LANDSCAPE"), ()),
)
CURVES = {"MOBILIZATION": "step", "SITE_PREP": "front", "FOUNDATION": "concentrated", "STRUCTURE": "normal", "ENVELOPE": "extended", "MEP_ROUGH": "extended", "FINISHES": "back", "SITE_FINISHES": "back", "OTHER": "extended"}


def trade(name: Column) -> Column:
    """struct<trade, secondary, cost_weight, intensity>"""

    def as_struct(t: str, more: tuple[str, ...], weight: float, intensity: float) -> Column:
        return F.struct(F.lit(t).alias("trade"), F.array(*map(F.lit, more)).cast("array<string>").alias("secondary"), F.lit(weight).alias("cost_weight"), F.lit(intensity).alias("intensity"))

    upper = F.upper(F.coalesce(name, F.lit("")))
    rules = [F.when(upper.rlike(p), as_struct(*rest)) for p, *rest in TRADES]
    return F.coalesce(*rules, as_struct(GENERAL, (), 0.5, 0.5))


def zone(name: Column) -> Column:
    upper = F.upper(F.coalesce(name, F.lit("")))
    return F.when(upper.rlike("|".join(EAST)), "EAST").when(upper.rlike("|".join(WEST)), "WEST").otherwise("SHARED")


def phase(name: Column, activity_id: Column) -> Column:
    upper, uid = F.upper(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(activity_id, F.lit("")))
    out = F.lit("OTHER")
    for label, inside, heads in reversed(PHASES):
        hit = reduce(Column.__or__, [*(upper.contains(x) for x in inside), *(uid.startswith(x) for x in heads)])
        out = F.when(hit, label).otherwise(out)
    return out


def curve_of(phase_name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CURVES.items() for x in pair])[phase_name]


def curve_value(curve: Column, t: Column) -> Column:
    """Cost intensity at share ``t`` of the way."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return (
        F.when(curve == "step", (t > 0).cast("double")).when(curve == "front", 2 * (1 - t)).when(curve == "concentrated", 6 * t * (1 - t))
        .when(curve == "normal", F.greatest(F.lit(0.0), F.cos(F.pi() * t) * F.pi() / 2)).when(curve == "back", 2 * t).otherwise(F.lit(1.0))
    )
