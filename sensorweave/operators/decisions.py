"""Decision rules stated before the data were seen, as expressions: each names what a row of estimates supports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The verdicts of each set of rules.
AVERAGING = {"noise": "1: noise all the way down", "local": "2: stable but local", "smooth": "3: stable and smooth", "mixed": "mixed"}
CONTROL = {"full": "R1: full pass", "stable": "R2: stability only", "G": "R3: partial pass (G)", "P": "R3: partial pass (P)", "mixed": "mixed", "fails": "R4: control fails"}
LAND_USE = {
    "more": "L1: land use explains NO2 more", "unresolved": "L2: NO2 signal, contrast unresolved", "none": "L3: no detectable land-use signal", "overlap": "L3/L4 overlap: described cell by cell",
    "other": "L5: signal, but not the road signal", "less": "L4: PM2.5 more than NO2", "unlabelled": "unlabelled: described cell by cell",
}


def averaging(gain_low: Column, fade_high: Column, reliability: Column, best_interpretable: Column, near_minus_far: Column, mantel_p: Column, alpha: float = 0.05) -> Column:
    """What longer averaging shows: gain_low is the lower end of the gain in reliability, fade_high the upper end of the change in decay.

    Noise, if there is no sure gain or no interpretable window reaches a reliability of 0.2; else a pattern (0.3 or more) is local without smooth decay or fading, smooth with both.
    """
    gain, fade, stable = gain_low > 0, fade_high < 0, reliability >= 0.3
    smooth = (near_minus_far > 0) & (mantel_p < alpha)
    return (
        F.when(~gain | (best_interpretable < 0.2), AVERAGING["noise"]).when(stable & smooth & fade, AVERAGING["smooth"]).when(stable & ~smooth & ~fade, AVERAGING["local"]).otherwise(AVERAGING["mixed"])
    )


def control(stable: Column, gradient: Column, predictable: Column) -> Column:
    """Whether a positive control passes its criteria S, G and P."""
    either = gradient | predictable
    one = F.when(gradient, CONTROL["G"]).otherwise(CONTROL["P"])
    return F.when(stable, F.when(gradient & predictable, CONTROL["full"]).when(either, one).otherwise(CONTROL["stable"])).when(either, CONTROL["mixed"]).otherwise(CONTROL["fails"])


def criteria(reliability: Column, reference_reliability: Column, gains_low: Column, near_minus_far: Column, mantel_p: Column, contrast_low: Column, gap: Column, gap_high: Column, gap_contrast_high: Column, ratio: float = 2.0, floor: float = -5.0, alpha: float = 0.05) -> tuple[Column, Column, Column]:
    """S (reliability beyond the reference's by a ratio, gains sure), G (likeness falls with distance, more than the reference's) and P (errors sure to be below the mean's by `floor` per cent)."""
    return (gains_low > 0) & (reliability >= ratio * reference_reliability), (near_minus_far > 0) & (mantel_p < alpha) & (contrast_low > 0), (gap_high < 0) & (gap_contrast_high < 0) & (gap <= floor)


def right_sign(expected: dict[str, int], betas: dict[str, Column], ts: dict[str, Column]) -> Column:
    """Some slope has its expected sign, and none has the other one with |t| above 2."""
    some, wrong = F.lit(False), F.lit(False)
    for name, sign in expected.items():
        some |= F.signum(betas[name]) == sign
        wrong |= (F.signum(betas[name]) == -sign) & (F.abs(ts[name]) > 2)
    return some & ~wrong


def land_use(r2: Column, p: Column, sign: Column, r2_other: Column, p_other: Column, sign_other: Column, low: Column, high: Column, alpha: float = 0.05) -> Column:
    """Which of two outcomes land use explains: skill, p and signs of each, and the interval of the difference in skill. The first rule that holds counts."""
    found, found_other, none = (p < alpha) & (r2 > 0), (p_other < alpha) & (r2_other > 0), (p >= alpha) & (p_other >= alpha)
    rules = [
        (found & sign & (low > 0), "more"), (found & sign & (low <= 0) & (high >= 0) & ~found_other, "unresolved"), (none & (high < 0), "overlap"), (none, "none"),
        (((p < alpha) & ~sign) | ((p_other < alpha) & ~sign_other), "other"), ((high < 0) | ((p_other < alpha) & (p >= alpha)), "less"),
    ]
    out = F
    for rule, name in rules:
        out = out.when(rule, LAND_USE[name])
    return out.otherwise(LAND_USE["unlabelled"])
