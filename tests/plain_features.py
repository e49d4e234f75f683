"""The hundred features of both variants, token by token and slowly, from their definitions: for comparison only."""

import math
import re
import statistics

from tessella.operators.dom import CONTAINERS, MAX_TOKEN_CHARS, SECTIONS, parse

VOWELS = "aeiouàèéìòù"


def is_tag(x):
    return x.name is not None


def tags_in(x):
    return [c for c in x.children if is_tag(c)]


def all_below(x):
    for c in x.children:
        yield c
        yield from all_below(c)


def markup(x, memo):
    if x.index not in memo:
        memo[x.index] = (x.name, tuple(sorted(x.attrs.items())), tuple(markup(c, memo) for c in x.children)) if is_tag(x) else x.text
    return memo[x.index]


def shown(x):
    kinds = (x.name,) if x.name in CONTAINERS else ("text", "cdata")
    return [s for c in all_below(x) if not is_tag(c) and c.kind in kinds and (s := c.text.strip())]


def over(x):
    while x.parent is not None:
        x = x.parent
        yield x


def height(x):
    return max((1 + height(c) for c in tags_in(x)), default=0)


def ratio(a, b):
    return a / b if b else 0.0


def special(text):
    return sum(not c.isalnum() and not c.isspace() for c in text)


def digits(text):
    return sum(map(str.isdigit, text))


def tokens_of(html):
    nodes = parse(html)
    return [(t, x.parent) for x in nodes if not is_tag(x) and (t := x.text.strip()) and len(t) <= MAX_TOKEN_CHARS]


def style_number(style, name):
    m = re.search(rf"{name}\s*:\s*([\d.]+)", style)
    try:
        return float(m[1]) if m else 0.0
    except ValueError:
        return 0.0


def text_part(text):
    words = text.split()
    n, low = len(text), text.lower()
    vowels = sum(c in VOWELS for c in low)
    runs = re.findall("[A-ZÀ-ÖØ-Ý]+", text)
    return {
        "length": n, "n_words": len(words), "avg_word_length": sum(map(len, words)) / len(words), "n_digits": digits(text),
        "n_uppercase": sum(map(str.isupper, text)), "n_periods": text.count("."), "n_special_chars": special(text),
        "n_sentences": len(re.findall("[.!?]+", text)), "is_numeric_token": float(text.isdigit()),
        "is_mixed_alphanum": float(any(map(str.isdigit, text)) and any(map(str.isalpha, text))),
        "keyword_score_title": sum(w.lower() in ("via", "trilocale", "bilocale", "appartamento") for w in words) / len(words),
        "char_entropy": -sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text)), "distinct_ratio": len(set(text)) / n,
        "vowel_ratio": vowels / n, "cv_balance": (sum(c.isalpha() and c not in VOWELS for c in low) - vowels) / n,
        "max_digit_run": max(map(len, re.findall(r"\d+", text)), default=0),
        "uniq_bigram_ratio": ratio(len({text[i : i + 2] for i in range(n - 1)}), n - 1), "cap_run_norm": max(map(len, runs), default=0) / n,
    }


def around(values, k, reach=2):
    own = values[max(0, k - reach) : k + reach + 1]
    return statistics.mean(own), statistics.pstdev(own)


def neighbours(lengths, k):
    before = lengths[k - 1] if k else lengths[k]
    after = lengths[k + 1] if k + 1 < len(lengths) else lengths[k]
    high = max(before, after) or 1
    return {
        "length_is_local_max": float(lengths[k] > before and lengths[k] > after), "length_peak_prominence": max(0.0, (lengths[k] - high) / high),
        "length_gradient_sign": (after > before) - (after < before),
    }


def element_part(node):
    style, classes = node.attrs.get("style", ""), node.classes
    return {
        "n_ancestors_with_class": sum(bool(x.classes) for x in over(node)), "n_ancestors_with_id": sum(bool(x.attrs.get("id")) for x in over(node)),
        "n_ancestors_div": sum(x.name == "div" for x in over(node)), "n_ancestors_section": sum(x.name in SECTIONS for x in over(node)),
        "has_grandparent": float(len(list(over(node))) > 1), "has_only_text_children": float(not tags_in(node)),
        "font_size_extracted": style_number(style, "font-size"), "margin_top_extracted": style_number(style, "margin-top"),
        "n_classes": len(classes), "class_name_length_avg": ratio(sum(map(len, classes)), len(classes)), "id_name_length": len(node.attrs.get("id", "")),
        "is_link": float(node.name == "a"), "link_href_depth": node.attrs.get("href", "").count("/") if node.name == "a" else 0,
        "css_title_score": next((1 / (k + 1) for k, c in enumerate(classes) if "title" in c.lower()), 0.0),
    }


def first(html, delimiter="€", keyword="locali"):
    """Rows of the first variant; scores that a deviation of 0 would divide are 0."""
    tokens, memo = tokens_of(html), {}
    texts, n = [t for t, _ in tokens], len(tokens)
    lengths, counts = [len(t) for t in texts], [len(t.split()) for t in texts]
    vocabulary = {w.lower() for t in texts for w in t.split()}
    deepest = max((len(list(over(x))) for _, x in tokens), default=0)
    means = [sum(map(len, t.split())) / len(t.split()) for t in texts]
    out = []
    for k, (text, node) in enumerate(tokens):
        up = list(over(node))
        depth, parent, below = len(up), node.parent, list(all_below(node))
        tags, strings = [x for x in below if is_tag(x)], [x.text.strip() for x in below if not is_tag(x)]
        peers = tags_in(parent) if parent else []
        others = [x for x in peers if x is not node]
        block = parent or node
        joined, visible = "".join(shown(block)), shown(block)
        sizes = [len(w) for w in joined.split()]
        outer = block.parent
        alike = {markup(x, memo) for x in tags_in(block)}
        places = [j for j, (_, x) in enumerate(tokens) if markup(x, memo) in alike]
        before = [j for j in places if j < k]
        after = [j for j in places if j > k]
        child_tags, block_depth = (len(peers), depth - 1) if parent else (0, 1)
        rates = [ratio(len(shown(x)), len(tags_in(x))) for x in up]
        relative = ratio(k, n - 1)
        spread = {c: statistics.stdev(v) if n > 1 else 1.0 for c, v in (("l", lengths), ("w", counts))}
        own = {w.lower() for w in text.split()}
        low, high = sum(map(str.islower, text)), sum(map(str.isupper, text))
        marks = [j for j, t in enumerate(texts) if delimiter in t]
        since = max((j for j in marks if j <= k), default=-1)
        until = min((j for j in marks if j > since), default=n)
        inside = list(range(since + 1, until))
        keys = [j for j in inside if keyword in texts[j].lower()]
        in_block = {"length_rank_in_block": 0, "length_z_to_block_median": 0, "dist_from_last_price_token": 0, "is_between_price_and_locali": 0}
        if k not in marks:
            values = [lengths[j] for j in inside]
            deviation = statistics.stdev(values) if len(values) > 1 else 1.0
            in_block = {
                "length_rank_in_block": sorted(inside, key=lambda j: (-lengths[j], j)).index(k) + 1,
                "length_z_to_block_median": ratio(lengths[k] - statistics.median(values), deviation),
                "dist_from_last_price_token": k - since, "is_between_price_and_locali": float(bool(keys) and k < keys[0]),
            }
        style = node.attrs.get("style", "")
        display = re.search(r"display\s*:\s*([^;]+)", style)
        window, window_words = around(lengths, k), around(means, k)
        out.append(text_part(text) | element_part(node) | neighbours(lengths, k) | in_block | {
            "capital_ratio": ratio(high, high + low), "percentile_token_length": 0, "token_distance_to_next": 0, "token_distance_to_prev": 0,
            "relative_position": relative, "relative_depth_ratio": depth + 1 / deepest if deepest else 0, "normalized_token_length": lengths[k] / statistics.mean(lengths),
            "token_repeated_in_page": texts.count(text), "tf_log": math.log2(texts.count(text) + 1),
            "length_zscore": ratio(lengths[k] - statistics.mean(lengths), spread["l"]), "n_words_zscore": ratio(counts[k] - statistics.mean(counts), spread["w"]),
            "uniq_ratio": len(own) / len(vocabulary),
            "neigh_len_diff": (abs(lengths[k] - (lengths[k - 1] if k else 0)) + abs(lengths[k] - (lengths[k + 1] if k + 1 < n else 0))) / 2,
            "n_parents": depth, "n_children": len(tags_in(node)), "n_descendants": len(below), "max_child_depth": height(node),
            "n_siblings": len(others), "tag_index_among_siblings": [markup(x, memo) for x in peers].index(markup(node, memo)) if peers else 0,
            "n_siblings_with_text": sum(bool(shown(x)) for x in peers), "avg_sibling_text_length": ratio(sum(len("".join(shown(x))) for x in peers), len(peers)),
            "n_unique_tags_among_siblings": len({x.name for x in peers}), "text_density": ratio(lengths[k], len(tags_in(node))),
            "has_style_attribute": float(bool(style)), "n_style_properties": sum(":" in x for x in style.split(";")),
            "display_type_code": {"none": 0, "block": 1, "inline": 2}.get(display[1].strip() if display else "", 3), "parent_tag_token_count": len(peers),
            "n_child_tokens_with_digits": sum(digits("".join(shown(x))) > 0 for x in tags_in(node)), "n_descendants_with_digits": sum(digits(s) > 0 for s in strings),
            "n_descendants_with_links": sum(x.name == "a" for x in tags),
            "n_descendants_with_buttons": sum(x.name == "button" or x.attrs.get("role") == "button" for x in tags), "dom_path_length": 1,
            "ancestors_text_density_variance": statistics.pvariance(rates) if len(rates) > 1 else 0,
            "sibling_text_density": ratio(sum(len("".join(shown(x))) for x in others), len(others)), "block_text_token_density": ratio(len(visible), child_tags),
            "block_tag_density": ratio(child_tags, block_depth), "descendants_text_density": ratio(sum(map(bool, strings)), len(tags)),
            "ancestors_avg_tag_density": ratio(sum(len(tags_in(x)) / (len(list(over(x))) or 1) for x in up), len(up)),
            "text_ratio_in_block": len(joined) / (len("".join(shown(outer))) or 1 if outer else 1),
            "tag_ratio_in_block": ratio(sum(map(is_tag, all_below(block))), sum(map(is_tag, all_below(outer))) if outer else 0),
            "block_avg_word_length": statistics.mean(sizes) if sizes else 0, "block_std_word_length": statistics.pstdev(sizes) if len(sizes) > 1 else 0,
            "block_avg_sentence_count": ratio(joined.count("."), len(sizes)), "descendants_link_density": ratio(sum(x.name == "a" for x in tags), len(tags)),
            "descendants_img_density": ratio(sum(x.name == "img" for x in tags), len(tags)), "block_special_char_density": ratio(special(joined), len(joined)),
            "block_digit_density": ratio(digits(joined), len(joined)), "token_dist_to_block_mid": ratio(abs(k - (len(places) - 1) / 2), len(places)),
            "block_token_count": len(visible), "block_depth_wtd_token_den": len(visible) / (block_depth or 1),
            "siblings_tag_density": ratio(sum(len(tags_in(x)) for x in others), len(others)), "local_subtree_height": height(block) + 1 if parent else 0,
            "parent_child_ratio": child_tags / (block_depth or 1), "block_text_length_ratio": len(joined) / sum(lengths),
            "local_token_rep_density": statistics.mean([texts.count(s) for s in visible]) if visible else 0,
            "block_avg_token_distance": ((k - before[-1] if before else 0) + (after[0] - k if after else 0)) / 2 if k in places else 0,
            "normalized_block_area": (relative + (depth + 1) / deepest) / 2 if deepest else 0,
            "window_mean_length": window[0], "window_std_length": window[1], "window_mean_avg_word_length": window_words[0], "window_std_avg_word_length": window_words[1],
        })
    return out


def second(html):
    """Rows of the second variant: elements with tokens only, equal markup as one, children once for each of their tokens."""
    tokens, memo = tokens_of(html), {}
    texts, n = [t for t, _ in tokens], len(tokens)
    if not n:
        return []
    keys, lengths = [markup(x, memo) for _, x in tokens], [len(t) for t in texts]
    counts = [len(t.split()) for t in texts]
    up_keys = [markup(x.parent, memo) if x.parent else None for _, x in tokens]
    holder = dict(zip(keys, (x for _, x in tokens), strict=True))
    parent = dict(zip(keys, up_keys, strict=True))
    lists = {p: [j for j in range(n) if up_keys[j] == p] for p in set(up_keys) - {None}}
    depth = dict.fromkeys(keys, 0)
    for key in keys:
        depth[key] = depth.get(parent[key], 0) + 1
    deepest = max(depth.values())

    def children(key):
        return [keys[j] for j in lists.get(key, ())]

    def below(key):
        return [y for c in children(key) for y in (c, *below(c))]

    def levels(key):
        return 1 + max(map(levels, children(key)), default=0)

    def density(key):
        found = below(key)
        return sum(lengths[j] for j in range(n) if keys[j] in found) / (len(found) or 1)

    def chain(key):
        key = parent[key]
        while key in depth:
            yield key
            key = parent[key]

    means = [sum(map(len, t.split())) / len(t.split()) for t in texts]
    price = re.compile(r"\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?\s*€\b", re.I)
    rooms = re.compile(r"\b\d+(?:[.,]\d+)?\s*locali?\b", re.I)
    prices, room_places = [[j for j in range(n) if x.search(texts[j])] for x in (price, rooms)]
    spread = {c: statistics.pstdev(v) if n > 1 else 1.0 for c, v in (("l", lengths), ("w", counts))}
    out = []
    for k, (text, node) in enumerate(tokens):
        key, found = keys[k], below(keys[k])
        nodes = [holder[x] for x in found]
        inner = [j for j in range(n) if keys[j] in found]
        chars = sum(lengths[j] for j in inner)
        words = [len(w) for j in inner for w in texts[j].split()]
        peers = [holder[x] for x in children(parent[key])] if parent[key] is not None else [holder[key]]
        entries = lists[parent[key]] if parent[key] is not None else []
        other = [len(children(keys[j])) for j in entries if tokens[j][1] is not node]
        block = [j for j in range(n) if up_keys[j] == up_keys[k]]
        values = [lengths[j] for j in block]
        deviation = statistics.pstdev(values) or 1.0
        peer_chars = [len("".join(shown(x))) for x in peers]
        rates = [density(x) for x in chain(key)]
        relative, ratio_of_depth = ratio(k, n - 1), (depth[key] + 1) / deepest
        gaps = [abs(lengths[k] - lengths[j]) for j in (k - 1, k + 1) if 0 <= j < n]
        style = node.attrs.get("style", "")
        display = re.search(r"display\s*:\s*([^;]+)", style)
        letters = sum(map(str.isalpha, text))
        window, window_words = around(lengths, k), around(means, k)
        between = prices and room_places and min(room_places) < k < max(room_places)
        out.append(text_part(text) | element_part(node) | neighbours(lengths, k) | {
            "capital_ratio": ratio(sum(map(str.isupper, text)), letters), "percentile_token_length": sum(x <= lengths[k] for x in lengths) / n,
            "token_distance_to_next": lengths[k + 1] if k + 1 < n else 0, "token_distance_to_prev": lengths[k - 1] if k else 0,
            "relative_position": relative, "relative_depth_ratio": ratio_of_depth, "normalized_token_length": lengths[k] / (sum(lengths) / n),
            "token_repeated_in_page": texts.count(text), "tf_log": math.log2(texts.count(text) + 1),
            "length_zscore": ratio(lengths[k] - statistics.mean(lengths), spread["l"]), "n_words_zscore": ratio(counts[k] - statistics.mean(counts), spread["w"]),
            "uniq_ratio": len(set(text.split())) / len({w for t in texts for w in t.split()}), "neigh_len_diff": sum(gaps) / 2,
            "n_parents": depth[key], "n_children": len(children(key)), "n_descendants": len(found), "max_child_depth": max((depth[x] for x in children(key)), default=0),
            "n_siblings": len(peers) - 1, "tag_index_among_siblings": children(parent[key]).index(key) if entries else 0,
            "n_siblings_with_text": sum(map(bool, peer_chars)), "avg_sibling_text_length": statistics.mean(peer_chars) if len(peers) > 1 else 0,
            "n_unique_tags_among_siblings": len({x.name for x in peers}), "text_density": density(key), "has_style_attribute": float("style" in node.attrs),
            "n_style_properties": len(style.split(";")) if style else 0,
            "display_type_code": {"none": 0, "block": 1, "inline": 2}.get(display[1].strip().lower() if display else "", 3),
            "parent_tag_token_count": len(below(parent[key])) if parent[key] in depth else 0,
            "n_child_tokens_with_digits": sum(digits("".join(shown(holder[x]))) > 0 for x in children(key)),
            "n_descendants_with_digits": sum(digits("".join(shown(x))) > 0 for x in nodes), "n_descendants_with_links": sum(x.name == "a" for x in nodes),
            "n_descendants_with_buttons": sum(x.name == "button" for x in nodes), "dom_path_length": len(list(over(node))),
            "ancestors_text_density_variance": statistics.pvariance(rates) if len(rates) > 1 else 0, "sibling_text_density": statistics.mean(peer_chars),
            "block_text_token_density": density(key), "block_tag_density": len(found) / (len({x.name for x in nodes}) or 1),
            "descendants_text_density": density(key), "ancestors_avg_tag_density": statistics.mean(rates) if rates else 0,
            "text_ratio_in_block": lengths[k] / (density(key) or 1), "tag_ratio_in_block": 1 / (len(found) or 1),
            "block_avg_word_length": statistics.mean(words) if words else 0, "block_std_word_length": statistics.pstdev(words) if len(words) > 1 else 0,
            "block_avg_sentence_count": statistics.mean([len(re.findall("[.!?]+", texts[j])) for j in inner]) if inner else 0,
            "descendants_link_density": sum(x.name == "a" for x in nodes) / (len(found) or 1), "descendants_img_density": sum(x.name == "img" for x in nodes) / (len(found) or 1),
            "block_special_char_density": sum(special(texts[j]) for j in inner) / (chars or 1), "block_digit_density": sum(digits(texts[j]) for j in inner) / (chars or 1),
            "token_dist_to_block_mid": abs(block.index(k) - (len(block) - 1) / 2) / len(block), "block_token_count": len(found),
            "block_depth_wtd_token_den": sum(keys.count(x) / (depth[x] or 1) for x in found) / (len(found) or 1),
            "siblings_tag_density": statistics.mean(other) if other else 0, "local_subtree_height": levels(key),
            "parent_child_ratio": len(children(key)) / (len(entries) or 1), "block_text_length_ratio": density(key) / sum(lengths),
            "local_token_rep_density": float(bool(inner)), "block_avg_token_distance": statistics.mean([abs(a - b) for a in inner for b in inner]) if inner else 0,
            "normalized_block_area": ratio_of_depth * relative, "length_rank_in_block": sorted(values, reverse=True).index(lengths[k]) + 1,
            "length_z_to_block_median": (lengths[k] - statistics.median(values)) / deviation,
            "dist_from_last_price_token": abs(k - prices[-1]) if prices else 0, "is_between_price_and_locali": float(bool(between)),
            "window_mean_length": window[0], "window_std_length": window[1], "window_mean_avg_word_length": window_words[0], "window_std_avg_word_length": window_words[1],
        })
    return out
