"""Fixed values of the data model.

Every literal below has to keep its value for results to be right.
"""

import math

# Fixed value: edge of the translation grid, in Angstrom.
GRID_SPACING = math.sqrt(3.0) / 3.0

# Fixed value: edge of a spatial bucket, in grid points.
BUCKET_SIZE = 16

# Widths of the stored pose fields (unsigned 16-bit ids, signed
# 16-bit grid coordinates).
MAX_INDEX = 65_535
MIN_GRID, MAX_GRID = -32_768, 32_767

# Fixed value: largest overlap RMSD the translation lattice covers, in Angstrom.
MAX_OVRMSD = math.sqrt(3.0)

# Fixed value: least filled share of a pose cell for an anchor pose to be kept.
MIN_CELL_FRACTION = 1 / 3

# Fixed value: longest O3'-P bond of a continuous backbone, in Angstrom.
MAX_BACKBONE_BOND = 2.2

# Fixed value: decimals of printed RMSDs.
RMSD_DECIMALS = 3

# Fixed value: largest rebuild error of a best-fit pose, in Angstrom.
MAX_REBUILD_RMSD = 0.002

POSE = ["conformer", "rotamer", "gx", "gy", "gz"]
BUCKET = ["mx", "my", "mz"]
OFFSET = ["ox", "oy", "oz"]
