"""Thresholds and regional projections. Every operator takes a ``Params``; the defaults are the published ones."""
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # pings -> trips
    h_acc_max: float = 65            # metres, keep below
    device_pings_min: int = 2        # keep devices with more
    trip_pings_min: int = 10         # keep trips with more
    avg_ping_max: float = 90         # seconds
    speed_max: float = 130           # km/h, keep below
    trip_gap: int = 600              # seconds, a longer pause starts a trip
    duration_min: float = 300        # seconds
    od_distance_min: float = 400     # metres, keep above
    clean_speed_max: float = 130     # km/h, errant pings inside a trace
    # final approach
    buffer_radius: float = 400       # metres; the donut is twice as wide
    roll_secs: int = 30
    walk_speed: float = 6            # km/h
    smooth_one_hz: bool = True       # two-step distance on 1 Hz stretches
    # parking lots
    service_class: int = 51
    freeway_class: int = 11
    lot_buffer: float = 10
    street_buffer: float = 5
    lot_search: float = 100
    curb_search: float = 200
    # routing
    turn_penalty: int = 100000
    one_way_cost: float = 1_000_000
    netwkdist_max: float = 1e6
    route_cap_start: float = 0.02    # hours searched first when no upper bound is known
    # map matching
    match_radius: float = 50
    match_min_points: int = 3
    gps_sigma: float = 8
    transition_beta: float = 20
    route_factor: float = 2.0        # links are first searched up to this many times the straight distance plus twice match_radius
    route_speed: float = 12          # m/s; or as far as this speed goes between the pings; neither changes the result
    noise_factor: float = 4          # a step back along a street of this many gps_sigma is noise, a longer one a lap
    # classification
    excess_min: float = 5
    high_excess_min: float = 200
    max_dist: float = 1400
    buffer_share: float = 0.5
    quality_cutoff: float = 0.9
    ping_mean_max: float = 30
    ping_max_max: float = 60
    time_zone: str = "UTC"
    fix_holidays: bool = False
    # physical layout: no task ever has to hold more of one device or trip than this
    chunk_secs: int = 3600           # time slice of a device or trip
    chunk_rows: int = 500_000        # pings of a device in one task, about: fuller slices are cut between seconds
    part_rows: int = 50_000          # points of a trip in one part
    search_tile: float = 8_000       # metres: streets are searched in tiles of this side, those that need more in tiles four times as wide
    search_halo: float = 2_000       # metres of streets held around a tile, around a wide one eight times that
    search_arcs: int = 300_000       # directions of streets in one task, at most: fuller tiles are searched by joins
    search_sources: int = 1_000      # sources in one task, about
    search_states: int = 5_000       # ways with their streets from one source, at most: more are found by joins
    viterbi_steps: int = 512         # pings decoded in one group, at most
    viterbi_rows: int = 1_000_000    # links in one group, about

    @property
    def search_tiles(self):
        """Side of a tile and width of what is held around it, tried in turn."""
        return (self.search_tile, self.search_halo), (4 * self.search_tile, 8 * self.search_halo)


# Logistic model of match quality.
MATCH_COEFFICIENTS = {
    "(Intercept)": 4.5289042565,
    "frechet_dist": -0.0446756552965,
    "ll_topol_min": 0.00200883204845,
}


@dataclass(frozen=True)
class LambertZone:
    """Lambert conformal conic with two standard parallels; degrees and metres."""
    lat1: float
    lat2: float
    lat0: float
    lon0: float
    x0: float
    y0: float
    a: float = 6378137.0
    inv_f: float = 298.257222101


# Fixed values from the public EPSG registry (3493, 2809, 2855).
REGIONS = {
    "ca": LambertZone(38 + 26 / 60, 37 + 4 / 60, 36.5, -120.5, 2_000_000, 500_000),
    "sf": LambertZone(38 + 26 / 60, 37 + 4 / 60, 36.5, -120.5, 2_000_000, 500_000),
    "mi": LambertZone(43 + 40 / 60, 42 + 6 / 60, 41.5, -(84 + 22 / 60), 4_000_000, 0),
    "wa": LambertZone(48 + 44 / 60, 47.5, 47.0, -(120 + 50 / 60), 500_000, 0),
}
