"""Physical constants, SI units unless said otherwise."""

# They must equal the published processing scheme's for equal results.
VON_KARMAN = 0.41
GRAVITY = 9.81
GAS_CONSTANT = 8.314
GAS_CONSTANT_DRY = 287.04
GAS_CONSTANT_VAPOUR = 461.5
MOLAR_MASS_DRY = 0.02897
MOLAR_MASS_WATER = 0.01802
MU = MOLAR_MASS_DRY / 18.02e-3
ET_PER_H2O_FLUX = 0.0648
STANDARD_MOLAR_VOLUME = 0.02245
RH_LIMIT = 130.0
MISSING = -9999.0
