"""Fixed values the results are compared against."""

import numpy as np

# Eight documents over eight columns, row by row.
EIGHT_DOCUMENTS = [
    [0.1, 0.5, 0.8, 0.7, 0.8, 0.8, 0.0, 0.8],
    [0.7, 0.8, 0.6, 0.1, 0.4, 0.8, 0.7, 0.0],
    [0.8, 0.6, 0.4, 0.1, 0.2, 0.4, 0.3, 0.2],
    [0.6, 0.5, 0.2, 0.1, 0.0, 0.5, 0.3, 0.9],
    [0.5, 0.0, 0.1, 0.3, 0.0, 0.6, 0.0, 0.9],
    [0.5, 0.9, 0.7, 0.7, 0.0, 0.7, 0.8, 0.3],
    [0.2, 0.3, 0.5, 0.8, 0.9, 0.1, 0.0, 0.4],
    [0.1, 0.7, 0.7, 0.1, 0.2, 0.9, 0.5, 0.0],
]

# Encoder weights, 3 hidden units by 8 columns plus bias in last
# place, listed column by column.
ENCODER = [
    -0.02749883843582579, 0.3885659693044735, 0.12338758351069523, -0.49328892524752843,
    0.044969602622286, 0.4745563106029106, 0.38694445472650685, -0.38372880601611337,
    -0.062390538892880154, -0.25334788575774025, -0.30328334430017545, 0.17846390397614842,
    -0.350372270654728, -0.2115447060418082, -0.24859061504374413, 0.16905491186420063,
    -0.4071069940604469, 0.30770514703192475, 0.06600088084827294, -0.09382450497286898,
    -0.08245441151794675, -0.4256991219095714, 0.48958698715211046, -0.20666930040210252,
    -0.1837388602590141, -0.029011345924522036, -0.026620962434521944,
]

# Decoder weights, 8 columns by 3 hidden units plus bias in last
# place, listed column by column.
DECODER = [
    -0.2784042410193389, -0.43474429155673244, -0.04101086891670236, 0.15602472157148994,
    -0.3631093163523623, 0.4985954840794409, 0.30088178790775966, -0.4624777859078858,
    -0.29111299467350793, 0.33210147278455915, -0.04564976169482615, 0.49835025432941116,
    1.4614625626463429e-05, 0.2541163148213885, -0.3470670934779829, 0.1870377967317276,
    -0.47379917589736753, -0.0173737815065379, -0.176288714981932, 0.3472489070257262,
    0.1253878462316631, -0.4482917083342266, 0.15690820304674835, 0.4845595333517968,
    -0.39446130663959855, -0.06500027173880008, -0.16134311210773566, 0.38345525443324147,
    0.23075609784562723, -0.26013818655508947, 0.18574088362651908, -0.12332034876961295,
]

# Reconstruction of the first document with the weights above.
FIRST_RECONSTRUCTION = [
    0.30078886802814037, 0.47699612396134006, 0.4288588404462507, 0.689800941335419,
    0.5462324762637724, 0.4359127392510418, 0.5601141475386238, 0.5156652894700111,
]

# Weights of a 5-7-1 network, bias first.
NETWORK_HIDDEN = [
    [2.54631575950577, -2.72375471180638, -1.83131523622017, -0.832303531504013, -1.28869970471936, -0.460188104184124],
    [-1.52091024201213, 1.81815348316090, -0.533406209340414, 1.77153723107141, -1.70376378930231, 1.95852409868481],
    [0.604392922735100, -0.312805008341265, 2.46338861792203, -2.77264318419692, -2.74202474572555, 0.142284005609256],
    [-0.0792951314491902, 0.652983968878905, 2.35836765255640, -2.04274164893227, 1.39603060318734, -1.68208055847319],
    [2.21352121948139, 1.65144527075334, -0.507588360889342, -1.68141383648426, -0.310581480324221, 0.973756570035639],
    [1.48264358368951, 2.38613449604874, 2.22681802175890, -1.70428719030501, 2.44271213316363, 1.91268676272635],
    [-0.246256073282793, 1.34750367072394, -2.50094445126864, 0.587138926992906, -0.192365052800164, -2.71732925728203],
]
NETWORK_OUTPUT = [
    [1.25592501437006, -0.834980000207940, 2.29875024099543, 0.0194882319892158,
     1.45126037957791, -0.492648144141757, -1.35365058999520, -2.15014190874756],
]


def encoder() -> np.ndarray:
    return np.array(ENCODER).reshape(9, 3).T


def decoder() -> np.ndarray:
    return np.array(DECODER).reshape(4, 8).T


def two_groups(width: int, rows: int) -> list[list[float]]:
    """0/1 rows: the first half switched on on the left, the second on the right, with a few gaps."""
    half = width // 2
    out = []
    for r in range(rows):
        left = r < rows // 2
        row = [1.0 if (c < half) == left else 0.0 for c in range(width)]
        gap = (r * 5 + 1) % half + (0 if left else half)
        row[gap] = 0.0
        out.append(row)
    return out
