"""Brute-force feature computation on Python lists, straight from the definitions.

Ticks are dicts with ts (seconds), price, bid, ask, bid_size, ask_size, listed in
arrival order within one stream.
"""

import math


def ret(now, before):
    return math.log(now / before) if before > 0 else 0.0


def pstd(values):
    if len(values) < 2:
        return 0.0
    mean = math.fsum(values) / len(values)
    return math.sqrt(math.fsum((v - mean) ** 2 for v in values) / len(values))


def steps(ticks):
    return [ret(b["price"], a["price"]) for a, b in zip(ticks, ticks[1:])]


def bps(tick):
    mid = (tick["bid"] + tick["ask"]) / 2
    return (tick["ask"] - tick["bid"]) / mid * 1e4 if mid > 0 else 0.0


def imbalance(tick):
    total = tick["bid_size"] + tick["ask_size"]
    return (tick["bid_size"] - tick["ask_size"]) / total if total > 0 else 0.0


def inside(ticks, i, w):
    return [t for t in ticks[: i + 1] if t["ts"] >= ticks[i]["ts"] - w]


def core(ticks, i, w):
    win = inside(ticks, i, w)
    prices = [t["price"] for t in win]
    r = steps(win)
    return {
        "log_return": ret(ticks[i]["price"], ticks[i - 1]["price"]) if i else 0.0,
        f"vol_{w}s": pstd(r),
        f"mean_return_{w}s": sum(r) / len(r) if r else 0.0,
        f"n_ticks_{w}s": len(win),
        f"trade_intensity_{w}s": len(win) / w,
        f"spread_mean_{w}s": sum(t["ask"] - t["bid"] for t in win) / len(win),
        f"price_range_{w}s": max(prices) - min(prices),
    }


def multi(ticks, i, windows):
    out = {}
    for w in windows:
        win = inside(ticks, i, w)
        prices = [t["price"] for t in win]
        r = steps(win)
        gaps = [(b["ts"] - a["ts"]) * 1000.0 for a, b in zip(win, win[1:])]
        price = ticks[i]["price"]
        out |= {
            f"return_{w}s": ret(price, win[0]["price"]),
            f"vol_{w}s": pstd(r),
            f"mean_return_{w}s": sum(r) / len(r) if r else 0.0,
            f"price_range_bps_{w}s": (max(prices) - min(prices)) / price * 1e4 if price else 0.0,
            f"spread_mean_bps_{w}s": sum(map(bps, win)) / len(win),
            f"trade_intensity_{w}s": len(win) / w,
            f"interarrival_mean_ms_{w}s": sum(gaps) / len(gaps) if gaps else 0.0,
            f"interarrival_std_ms_{w}s": pstd(gaps),
        }
    return out


def micro(ticks, i, windows, retention):
    kept = inside(ticks, i, retention)
    now = ticks[i]

    def win_return(w):
        return ret(now["price"], inside(ticks, i, w)[0]["price"])

    out = {}
    for w in windows:
        out[f"return_{w}s"] = win_return(w)
        out[f"vol_{w}s"] = pstd(steps(inside(ticks, i, w)))
    out["book_imbalance"] = imbalance(now)
    for w in (5, 15, 60):
        win = inside(ticks, i, w)
        out[f"book_imbalance_mean_{w}s"] = sum(map(imbalance, win)) / len(win)
    for w in (5, 60):
        win = inside(ticks, i, w)
        out[f"spread_change_{w}s"] = bps(now) - bps(win[0]) if len(win) > 1 else 0.0
    for w in (15, 60):
        recent = len(inside(ticks, i, w))
        out[f"intensity_change_{w}s"] = recent / w - (len(inside(ticks, i, 2 * w)) - recent) / w
    for name, alpha in (("ewma_vol_fast", 0.3), ("ewma_vol_slow", 0.1)):
        level = 0.0
        for r in steps(kept):
            level = alpha * abs(r) + (1 - alpha) * level
        out[name] = level
    out["vol_of_vol_60s"] = pstd(
        [ret(b["price"], a["price"]) for a, b in zip(kept, kept[1:]) if b["ts"] >= now["ts"] - 60]
    )
    out["momentum_15s"], out["momentum_60s"] = win_return(15), win_return(60)
    middle, oldest = inside(ticks, i, 120)[0]["price"], inside(ticks, i, 180)[0]["price"]
    out["acceleration_60s"] = win_return(60) - ret(middle, oldest)
    return out


def label(ticks, i, horizon, slack, retention, drain_tail):
    t = ticks[i]["ts"]
    closer = next((j for j in range(i, len(ticks)) if ticks[j]["ts"] - t >= horizon), None)
    if closer is None:
        if not drain_tail:
            return None
        closer = len(ticks) - 1
    seen = [x for x in ticks[: closer + 1] if x["ts"] >= ticks[closer]["ts"] - retention]
    win = [x for x in seen if t <= x["ts"] <= t + horizon]
    if len(win) < 2 or win[-1]["ts"] < win[0]["ts"] + horizon - slack:
        return None
    win = [x for x in win if x["ts"] <= win[0]["ts"] + horizon]
    return pstd(steps(win))
