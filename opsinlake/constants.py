"""Fixed values of the perception model.

Every number, name and order in this module is data that results depend on: template coefficients,
species tables, light notches, source presets, sensor bands and colour-fit coefficients.
"""

from __future__ import annotations

# ---------------------------------------------------------------- grids and tolerances (fixed values)
TEMPLATE_LO_NM, TEMPLATE_HI_NM, TEMPLATE_STEP_NM = 300.0, 750.0, 5.0
STEP_NM = 1.0
DEFAULT_SOFTNESS = 0.5
DROPLET_STEEPNESS_NM = 8.0
MAX_RECEPTORS = 64
ACTIVE_GAIN = 0.1
F32_TINY = 1.17549435e-38
LEGACY_REGIME = "Colorspace"

# Regularisation ladder of the sharpening solver (fixed values).
SHARPEN_LAMBDAS = (
    1e-3, 3e-3, 1e-2, 3e-2, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0,
)

# Planck's law (SI exact values).
PLANCK_H, LIGHT_C, BOLTZMANN_K = 6.62607015e-34, 2.99792458e8, 1.380649e-23

# Absorption notches: name, centre nm, width nm, depth (fixed values).
NOTCHES = (
    ("O2 A-band (~760nm)", 760.0, 2.0, 0.6),
    ("O2 B-band (~687nm)", 687.0, 1.5, 0.4),
    ("Water vapor 720nm", 720.0, 5.0, 0.3),
    ("Water vapor 820nm", 820.0, 8.0, 0.3),
    ("Water vapor 940nm", 940.0, 10.0, 0.5),
    ("Water vapor 1100nm", 1100.0, 10.0, 0.3),
    ("Water vapor 1130nm", 1130.0, 10.0, 0.3),
    ("Water vapor 1370nm", 1370.0, 15.0, 0.6),
    ("Water vapor 1450nm", 1450.0, 15.0, 0.5),
    ("Water vapor 1950nm", 1950.0, 20.0, 0.6),
    ("Water vapor 2500nm", 2500.0, 25.0, 0.5),
)

# Narrow-band sources: name, then (centre nm, amplitude, bandwidth nm) per component (fixed values).
SOURCES = (
    ("Low-pressure sodium vapor", ((589.0, 1.0, 0.3), (589.6, 1.0, 0.3))),
    ("High-pressure sodium vapor", ((589.0, 1.0, 15.0),)),
    (
        "Mercury vapor",
        ((365.0, 0.4, 2.0), (405.0, 0.3, 2.0), (436.0, 0.5, 2.0), (546.0, 1.0, 2.0), (578.0, 0.6, 2.0)),
    ),
    ("Cool white LED", ((450.0, 1.0, 15.0), (560.0, 0.7, 60.0))),
    ("Warm white LED", ((450.0, 0.5, 15.0), (580.0, 1.0, 70.0))),
)

# Sensor band centres, in sensor order (fixed values; the first is not increasing).
SENSORS = (
    (
        "Landsat 8/9 OLI (9 bands, approximate)",
        (443.0, 482.0, 561.5, 654.5, 865.0, 1373.5, 1609.0, 2201.0, 590.0),
    ),
    (
        "Sentinel-2 MSI (13 bands, approximate)",
        (443.0, 490.0, 560.0, 665.0, 705.0, 740.0, 783.0, 842.0, 865.0, 945.0, 1375.0, 1610.0, 2190.0),
    ),
)

# Seed lights and stimuli (fixed values).
UNIFORM_LIGHT = ("Uniform", ((300.0, 1.0), (750.0, 1.0)))
SOLAR_LIGHT = ("Daytime Earth solar (5778K black body)", 5778.0, 280.0, 2500.0, 2.0)
SEED_STIMULI = (
    ("Reddish", ((400.0, 0.2), (500.0, 0.2), (600.0, 0.8), (700.0, 0.8))),
    ("Greenish", ((400.0, 0.2), (530.0, 0.8), (600.0, 0.2), (700.0, 0.2))),
    ("Blueish", ((400.0, 0.8), (450.0, 0.8), (550.0, 0.2), (700.0, 0.2))),
)

# Visual systems (fixed values). Receptors are (name, peak nm); optional per-receptor maps are keyed by
# pool position; regimes are (name, member positions).
SYSTEMS = (
    dict(
        name="Human (Homo sapiens)",
        receptors=(("S-cone", 420.0), ("M-cone", 530.0), ("L-cone", 560.0)),
        regimes=(("Trichromat", (0, 1, 2)),),
        weights={0: 0.0, 1: 0.4, 2: 0.6},
        omega={0: 0.05, 1: 0.05, 2: 0.05},
        eta={0: 1.0, 1: 16.0, 2: 32.0},
        contrasts=(
            ("L - M (red-green)", (0.0, -1.0, 1.0)),
            ("(M+L)/2 - S (yellow-blue)", (-1.0, 0.5, 0.5)),
        ),
    ),
    dict(
        name="Dog (Canis lupus familiaris)",
        receptors=(("S-cone", 432.0), ("L/M-cone", 555.0)),
        regimes=(("Dichromat", (0, 1)),),
    ),
    dict(
        name="Cat (Felis catus)",
        receptors=(("450nm mechanism", 450.0), ("500nm mechanism", 500.0), ("556nm mechanism", 556.0)),
        regimes=(("Trichromat", (0, 1, 2)),),
    ),
    dict(
        name="Honeybee (Apis mellifera)",
        receptors=(("UV receptor", 344.0), ("Blue receptor", 436.0), ("Green/L receptor", 550.0)),
        regimes=(("Trichromat", (0, 1, 2)),),
        weights={2: 0.8},
        omega={0: 0.05, 1: 0.05, 2: 0.05},
        eta={0: 1.0, 1: 2.0, 2: 4.0},
        contrasts=(("UV - Blue", (1.0, -1.0, 0.0)), ("Green - (UV+Blue)/2", (-0.5, -0.5, 1.0))),
    ),
    dict(
        name="Pigeon (Columba livia)",
        # opsin name, peak nm, droplet name, 50 % cut-off nm
        filtered=(
            ("UV/violet (SWS1)", 409.0, "Transparent droplet", 200.0),
            ("Short-wave (SWS2)", 456.0, "Greenish/C-type droplet", 430.0),
            ("Medium-wave (RH2)", 510.0, "Yellow droplet", 475.0),
            ("Long-wave (LWS)", 567.0, "Orange/red droplet", 580.0),
        ),
        regimes=(("Tetrachromat", (0, 1, 2, 3)),),
    ),
    dict(
        name="Goldfish (Carassius auratus)",
        chromophore="A2",
        receptors=(
            ("UV receptor", 356.0),
            ("S/blue receptor", 455.0),
            ("M/green receptor", 530.0),
            ("L/red receptor", 625.0),
        ),
        regimes=(("Tetrachromat", (0, 1, 2, 3)),),
    ),
    dict(
        name="Penguin (Spheniscus humboldti)",
        receptors=(("Violet-sensitive (SWS1)", 403.0), ("S/blue receptor", 450.0), ("L/green receptor", 543.0)),
        regimes=(("Trichromat", (0, 1, 2)),),
    ),
    dict(
        name="Mouse (Mus musculus)",
        receptors=(("S-cone (UV)", 360.0), ("M-cone (green)", 508.0)),
        regimes=(("Dichromat", (0, 1)),),
    ),
    dict(
        name="Swallowtail Butterfly (Papilio xuthus)",
        receptors=(
            ("UV", 360.0),
            ("Blue", 460.0),
            ("Green", 520.0),
            ("Red", 600.0),
            ("Violet (non-color-vision)", 400.0),
        ),
        extra=(
            (
                "Broad-band (non-color-vision)",
                ((350.0, 0.3), (400.0, 0.7), (450.0, 0.9), (550.0, 0.9), (650.0, 0.7), (700.0, 0.4)),
            ),
        ),
        regimes=(("Color vision tetrachromat", (0, 1, 2, 3)),),
    ),
    dict(
        name="Frog (Rana spp.)",
        receptors=(
            ("Green rod", 433.0),
            ("Red rod", 502.0),
            ("Blue cone", 431.0),
            ("Middle/green cone", 502.0),
            ("Red cone", 580.0),
        ),
        regimes=(("Scotopic", (0, 1)), ("Mesopic", (0, 1, 2, 3, 4)), ("Photopic", (2, 3, 4))),
        # position: (lower bound, upper bound, softness)
        windows={
            0: (1e-6, 3e-2, 0.5),
            1: (1e-6, 3e-2, 0.5),
            2: (1e-2, None, 0.5),
            3: (1e-2, None, 0.5),
            4: (1e-2, None, 0.5),
        },
    ),
    dict(
        name="Mantis Shrimp (Stomatopoda)",
        receptors=(
            ("UV1", 325.0),
            ("UV2", 350.0),
            ("UV3", 370.0),
            ("UV4", 395.0),
            ("Midband row 1", 440.0),
            ("Midband row 2", 475.0),
            ("Midband row 3", 500.0),
            ("Midband row 4", 525.0),
            ("Midband row 5", 550.0),
            ("Midband row 6", 575.0),
            ("Midband row 7", 600.0),
            ("Midband row 8", 625.0),
        ),
        regimes=(),
    ),
)

# CIE 1931 multi-Gaussian fit (Wyman, Sloan & Shirley 2013): weight, mean, left sigma, right sigma.
CIE_X = ((1.056, 599.8, 37.9, 31.0), (0.362, 442.0, 16.0, 26.7), (-0.065, 501.1, 20.4, 26.2))
CIE_Y = ((0.821, 568.8, 46.9, 40.5), (0.286, 530.9, 16.3, 31.1))
CIE_Z = ((1.217, 437.0, 11.8, 36.0), (0.681, 459.0, 26.0, 13.8))
CIE_RANGE_NM = (360.0, 830.0)
# XYZ to linear sRGB, D65.
XYZ_TO_SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))

# Five viridis anchors at t = 0, 1/4, 1/2, 3/4, 1 (fixed values).
VIRIDIS = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))
# Blue ramp: base and slope per channel (fixed values).
BLUE_RAMP = ((20.0, 180.0), (30.0, 190.0), (60.0, 195.0))
# Opponent composite: (L, C1, C2) coefficients per output channel (fixed values).
OPPONENT_RGB = ((1.0, 0.55, 0.45), (1.0, -0.55, 0.45), (1.0, 0.0, -0.60))

# ENVI headers: data type code to numpy kind+size, and data file extensions in lookup order (fixed values).
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4"}
ENVI_DATA_EXTENSIONS = ("dat", "img", "raw", "bin")
