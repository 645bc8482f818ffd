"""Type-variable summary of an annotation.

Scope is resolved with positions instead of a tree. Every bracket group, binder
body and bound is an *interval* of token positions carrying a label; the labels
of the intervals that contain a position, widest first, are its constructor
stack (outermost first). A name is a variable occurrence when a binder of that
name has the position in its body, and the innermost such binder owns it.

The work is row local: a chain of projections over array columns, so it runs in
the stage that scans the annotations and needs no shuffle. ``summarize`` can
also run it once per distinct text (``dedupe=True``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeharvest.functions import lexical
from typeharvest.session import shuffle_width

TV_TYPE = (
    "array<struct<name:string,lb:string,ub:string,"
    "occurrs:array<array<string>>,context:array<string>>>"
)
SUMMARY_COLUMNS = ["UnrolledTypeAnnotation", "TypeVarsSummary", "Error", "Warning"]
DEFAULT_LB = "Union{}"
DEFAULT_UB = "Any"

#: binary operators that make a call of their operands
_ARITH = (
    "'+','-','*','/','\\\\','^','%','÷','==','!=','<=','>=','<','>','|','&','//','<<','>>',"
    "'===','!==','|>','~','≤','≥','≠','∈','∉','⊻'"
)
#: tokens no type expression may hold
_UNSUPPORTED = (
    "'::','=','->','=>','...','..','?','&&','||','[',']','\\'',';','+=','-=','*=','/=','.='"
)
_CONSTR = "'<:','>:'"

_NO_SPANS = "cast(array() as array<struct<s:int,e:int>>)"


#: the steps to the unrolled text, and the columns they read
_UNROLLED, _UNROLLED_FROM = ("_r0", "_r", "_un"), ("_t", "_g", "_s", "_w", "_do", "_b")


def _in_body(b: str, p: str) -> str:
    return (
        f"({p} between {b}.bs and {b}.be"
        f" and not exists({b}.ex, e -> {p} between e.s and e.e))"
    )


def _sources() -> list[tuple[str, str]]:
    """(column, SQL) projections, in order; each reads the earlier ones."""
    n, q, d, m, w, comma, below, above = (
        lexical.NAME, lexical.QUALIFIED_NAME, lexical.LITERAL, lexical.MACRO, lexical.WHERE, lexical.COMMA, lexical.BELOW, lexical.ABOVE)
    square, other, closers = lexical.SQUARE_OPEN, lexical.OTHER, (lexical.SQUARE_CLOSE, lexical.CURLY_CLOSE, lexical.ROUND_CLOSE)

    def of(p: str, *classes: int) -> str:
        """Whether the token at ``p`` is of one of the classes."""
        return "(" + " or ".join(f"get(_t_c, {p}) = {c}" for c in classes) + ")"

    # tokens by what is asked of them, so that a later step goes through the few it is about: all but operands
    # and brackets, then of these commas, constraint operators, wheres and others; and the places of operands
    rest = f"""
      transform(filter(_t_i, i -> get(_t_c, i) >= {m} and get(_t_c, i) <= {closers[0]}),
        i -> named_struct('i', i, 't', get(_src, i), 'k', get(_t_c, i),
          'par', coalesce(get(filter(_t_p, p -> i < p.c and i > p.o), 0).o, -1)))
    """
    commas = f"filter(_sp, x -> x.k = {comma})"
    constraints = f"filter(_sp, x -> x.k = {below} or x.k = {above})"
    where_words = f"filter(_sp, x -> x.k = {w})"
    others = f"filter(_sp, x -> x.k = {m} or x.k = {square} or x.k >= {other})"
    operands = f"filter(_t_i, i -> get(_t_c, i) <= {m})"
    # closed bracket groups with the commas at their own level
    groups = f"""
      transform(_t_p, p -> named_struct(
        'o', p.o, 'c', p.c,
        'commas', filter(_cm, y -> y.par = p.o).i,
        'rs', if({of('p.o - 1', *closers)},
            get(filter(_t_p, q -> q.c = p.o - 1), 0).o
              - if({of('get(filter(_t_p, q -> q.c = p.o - 1), 0).o - 1', n, q)}, 1, 0),
            p.o - 1),
        'kind',
          if(get(_t_c, p.c) = {closers[1]},
            if({of('p.o - 1', n, q, *closers[1:])} or ({of('p.o - 1', d)} and startswith(get(_src, p.o - 1), '"')), 'curly',
            if({of('p.o - 1', w)}, 'where', 'bare')),
          if(get(_t_c, p.c) = {closers[2]},
            if(get(_src, p.o - 1) = '$', 'esc',
            if(get(_src, p.o - 1) = ':', 'bare',
            if({of('p.o - 1', n, q, m, *closers[1:])}, 'call',
            if(p.c = p.o + 1 or exists(_cm, y -> y.par = p.o), 'tuple', 'paren')))),
          'square'))))
    """
    # spans the analysis never enters: tuples and escapes
    untraversed = "transform(filter(_g, g -> g.kind = 'tuple' or g.kind = 'esc'), g -> named_struct('s', g.o, 'e', g.c))"
    # shorthand arguments {<:U} / {>:L}
    short0 = f"""
      transform(filter(_ct, x -> {of('x.i - 1', lexical.CURLY_OPEN, comma)}
                  and exists(_g, g -> g.o = x.par and g.kind = 'curly')
                  and not exists(_u, u -> x.i between u.s and u.e)),
        x -> named_struct('op', x.i, 't', x.t, 'o', x.par,
          'c', get(filter(_g, g -> g.o = x.par), 0).c, 'rs', get(filter(_g, g -> g.o = x.par), 0).rs,
          'ae', coalesce(array_min(filter(get(filter(_g, g -> g.o = x.par), 0).commas, y -> y > x.i)),
                         get(filter(_g, g -> g.o = x.par), 0).c) - 1))
    """
    shorts = """
      transform(_s0, x -> named_struct('op', x.op, 't', x.t, 'o', x.o, 'c', x.c, 'rs', x.rs, 'ae', x.ae,
          'k', size(filter(_s0, y -> y.o = x.o and y.op <= x.op)),
          'm', size(filter(_s0, y -> y.o = x.o))))
    """
    # where keywords with the limits of their segment
    where0 = """
      transform(filter(_wt, x -> not exists(_u, u -> x.i between u.s and u.e)),
        x -> named_struct('w', x.i, 'par', x.par,
          'ss', 1 + greatest(x.par, coalesce(array_max(filter(_cm, y -> y.par = x.par and y.i < x.i).i), -1)),
          'se', -1 + coalesce(array_min(concat(
                  filter(_cm, y -> y.par = x.par and y.i > x.i).i,
                  filter(_g, g -> g.o = x.par and g.c > x.i).c)),
                  size(_src))))
    """
    where1 = """
      transform(_w0, x -> named_struct('w', x.w, 'par', x.par, 'ss', x.ss, 'se', x.se,
          'fw', array_min(filter(_w0, y -> y.par = x.par and y.w >= x.ss and y.w <= x.se).w),
          'de', coalesce(array_min(filter(_w0, y -> y.par = x.par and y.w > x.w and y.w <= x.se).w) - 1, x.se)))
    """
    wheres = """
      transform(_w1, x -> named_struct('w', x.w, 'par', x.par, 'fw', x.fw, 'de', x.de,
          'bs', 1 + coalesce(array_max(filter(_ct, y -> y.par = x.par and y.i >= x.ss and y.i < x.fw).i), x.ss - 1)))
    """
    # one declaration span per bound variable
    decls = """
      flatten(transform(_w, x -> if(get(_src, x.w + 1) = '{' and exists(_g, g -> g.o = x.w + 1),
        transform(
          filter(sequence(1, 1 + size(get(filter(_g, g -> g.o = x.w + 1), 0).commas)),
                 j -> get(filter(_g, g -> g.o = x.w + 1), 0).c > x.w + 2),
          j -> named_struct('w', x.w, 'bs', x.bs, 'par', x.w + 1,
            'ds', coalesce(get(get(filter(_g, g -> g.o = x.w + 1), 0).commas, j - 2), x.w + 1) + 1,
            'de', coalesce(get(get(filter(_g, g -> g.o = x.w + 1), 0).commas, j - 1),
                           get(filter(_g, g -> g.o = x.w + 1), 0).c) - 1,
            'be', if(j = 1, x.w - 1, get(get(filter(_g, g -> g.o = x.w + 1), 0).commas, j - 2) - 1))),
        array(named_struct('w', x.w, 'bs', x.bs, 'par', x.par, 'ds', x.w + 1, 'de', x.de, 'be', x.w - 1)))))
    """
    decl_ops = """
      transform(_d, d -> named_struct('d', d, 'ops', filter(_ct, y -> y.par = d.par and y.i between d.ds and d.de)))
    """

    def binder(name: str, at: str, ls: str, le: str, us: str, ue: str, ok: str) -> str:
        return (
            f"named_struct('name', {name}, 'npos', {at}, 'ls', {ls}, 'le', {le}, 'us', {us}, 'ue', {ue}, 'bs', x.d.bs,"
            f" 'be', x.d.be, 'prio', 0, 'nk', 0, 'ex', {_NO_SPANS}, 'o', -1, 'k', 0, 'ok', {ok})"
        )

    op, named_first = "get(x.ops, 0).i", f"get(x.ops, 0).i = x.d.ds + 1 and {of('x.d.ds', n)} and x.d.de > get(x.ops, 0).i"
    chained = (
        "size(x.ops) = 2 and get(x.ops, 0).t = '<:' and get(x.ops, 1).t = '<:' and get(x.ops, 1).i = get(x.ops, 0).i + 2"
        f" and {of('get(x.ops, 0).i + 1', n)} and get(x.ops, 0).i > x.d.ds and x.d.de > get(x.ops, 1).i"
    )
    binders = f"""
      concat(
        transform(_do, x ->
          if(size(x.ops) = 0, {binder('get(_src, x.d.ds)', 'x.d.ds', '-1', '-2', '-1', '-2', f"x.d.ds = x.d.de and {of('x.d.ds', n)}")},
          if(size(x.ops) = 1 and get(x.ops, 0).t = '<:', {binder(f'get(_src, {op} - 1)', f'{op} - 1', '-1', '-2', f'{op} + 1', 'x.d.de', named_first)},
          if(size(x.ops) = 1, {binder(f'get(_src, {op} - 1)', f'{op} - 1', f'{op} + 1', 'x.d.de', '-1', '-2', named_first)},
          {binder(f'get(_src, {op} + 1)', f'{op} + 1', 'x.d.ds', f'{op} - 1', 'get(x.ops, 1).i + 1', 'x.d.de', chained)})))),
        transform(_s, x -> named_struct('name', concat('#', x.op), 'npos', -1,
               'ls', if(x.t = '>:', x.op + 1, -1), 'le', if(x.t = '>:', x.ae, -2),
               'us', if(x.t = '<:', x.op + 1, -1), 'ue', if(x.t = '<:', x.ae, -2),
               'bs', x.rs, 'be', x.c, 'prio', 1, 'nk', -x.k,
               'ex', transform(filter(_s, y -> y.o = x.o and y.k >= x.k), y -> named_struct('s', y.op, 'e', y.ae)),
               'o', x.o, 'k', x.k, 'ok', x.ae > x.op)))
    """
    # spans of operator calls such as N + 1
    ends = " and ".join([f"y.k >= {w}", f"y.k <> {square}", f"y.k <= {above}"])
    arith = f"""
      array_distinct(transform(
        filter(_ot, x -> x.t in ({_ARITH}) and not exists(_u, u -> x.i between u.s and u.e)),
        x -> named_struct(
          's', 1 + greatest(x.par, coalesce(array_max(filter(_sp, y -> y.par = x.par and y.i < x.i
                 and {ends}).i), -1)),
          'e', -1 + coalesce(array_min(concat(
                 filter(_sp, y -> y.par = x.par and y.i > x.i and {ends}).i,
                 filter(_g, g -> g.o = x.par and g.c > x.i).c)), size(_src)))))
    """
    # widest first; what tells two of them apart comes before their lists
    intervals = f"""
      sort_array(concat(
        transform(filter(_g, g -> g.kind = 'curly'), g -> named_struct(
          'nl', -(g.c - g.o + 1), 'prio', 3, 'nk', 0,
          'lab', if(get(_src, g.o - 1) = 'Tuple', 'Tuple', if(get(_src, g.o - 1) = 'Union', 'Union',
                 if(exists(_b, b -> b.name = get(_src, g.o - 1) and {_in_body('b', '(g.o - 1)')}), 'Var', 'Invar'))),
          'b', -1, 'o', g.o, 's', g.o + 1, 'e', g.c - 1,
          'ex', transform(filter(_s, y -> y.o = g.o), y -> named_struct('s', y.op, 'e', y.ae)), 'cm', g.commas)),
        transform(filter(_g, g -> g.kind = 'call'), g -> named_struct(
          'nl', -(g.c - g.rs + 1), 'prio', 2, 'nk', 0,
          'lab', if({of('g.rs', m)}, 'MCall', 'Call'), 'b', -1, 'o', g.o, 's', g.rs, 'e', g.c,
          'ex', {_NO_SPANS}, 'cm', concat(array(g.o), g.commas))),
        transform(_c, a -> named_struct(
          'nl', -(a.e - a.s + 1), 'prio', 2, 'nk', 0, 'lab', 'Call', 'b', -1, 'o', -1, 's', a.s, 'e', a.e,
          'ex', {_NO_SPANS},
          'cm', filter(_ot, y -> y.t in ({_ARITH}) and y.i between a.s and a.e).i)),
        transform(_b, (b, id) -> named_struct(
          'nl', -(b.be - b.bs + 1), 'prio', b.prio, 'nk', b.nk, 'lab', 'Where', 'b', id, 'o', -1,
          's', b.bs, 'e', b.be, 'ex', b.ex, 'cm', cast(array() as array<int>))),
        transform(filter(_b, b -> b.ls >= 0), b -> named_struct(
          'nl', -(b.le - b.ls + 1), 'prio', 0, 'nk', 0, 'lab', 'LoBnd', 'b', -1, 'o', -1,
          's', b.ls, 'e', b.le, 'ex', {_NO_SPANS}, 'cm', cast(array() as array<int>))),
        transform(filter(_b, b -> b.us >= 0), b -> named_struct(
          'nl', -(b.ue - b.us + 1), 'prio', 0, 'nk', 0, 'lab', 'UpBnd', 'b', -1, 'o', -1,
          's', b.us, 'e', b.ue, 'ex', {_NO_SPANS}, 'cm', cast(array() as array<int>)))))
    """

    # the intervals around a position, widest first, each with its number there
    def path(p: str) -> str:
        return (
            f"transform(filter(_i, v -> {p} between v.s and v.e"
            f" and not exists(v.ex, e -> {p} between e.s and e.e)), v -> named_struct('lab', v.lab, 'b', v.b,"
            " 'n', if(v.b >= 0, 2, if(v.lab = 'LoBnd', 0, if(v.lab = 'UpBnd', 1,"
            f" size(filter(v.cm, y -> y < {p})))))))"
        )

    # variable occurrences with their paths
    occ0 = f"""
      transform(filter(_nt, i -> {of('i', n)} and exists(_b, b -> b.name = get(_src, i) and {_in_body('b', 'i')})
                  and not exists(_b, b -> b.npos = i)
                  and not exists(_u, u -> i between u.s and u.e)
                  and not ({of('i - 1', other)} <=> true
                           and (get(_src, i - 1) = '$' or get(_src, i - 1) = '.' or get(_src, i - 1) = ':'))),
        i -> named_struct('t', get(_src, i), 'path', {path('i')}))
    """
    # of each, its owner (the last on its path) and the labels below that
    occ = """
      transform(_o0, x -> get(transform(
        array(array_max(transform(x.path, (v, j) -> if(v.b >= 0 and get(_b, v.b).name = x.t, j + 1, 0)))),
        at -> named_struct('b', get(x.path, at - 1).b, 'ord', x.path.n, 'st', slice(x.path.lab, at + 1, size(x.path)))), 0))
    """
    # the path down to each binder: of its body, up to the binder itself
    ctx = f"transform(_b, (b, id) -> named_struct('id', id, 'path', {path('b.bs')}))"
    # a binder of an unreadable text may lie outside its own path; the row is an error then
    own = "coalesce(array_max(transform(x.path, (v, j) -> if(v.b = x.id, j, 0))), 0)"
    ctx1 = f"""
      transform(_x0, x -> named_struct(
        'ord', concat(slice(x.path.n, 1, {own}), array(3)), 'lab', slice(x.path.lab, 1, {own})))
    """

    # rendering: relocated token pieces, sorted by key
    def outer_key(p: str, last: str) -> str:
        return (
            f"concat(flatten(transform(filter(_s, z -> {p} > z.op and {p} <= z.ae),"
            f" z -> array(z.c, z.k))), {last})"
        )

    parens = f"""
      filter(_g, g -> g.kind <> 'paren' or (
        exists(_w, w -> w.par = g.o) and (
          coalesce(get(_t, g.o - 1).t in ({_CONSTR}), false)
          or coalesce(get(_t, g.c + 1).k = 'w' or get(_t, g.c + 1).t in ({_CONSTR}), false))))
    """
    opens = """
      (size(filter(_do, x -> x.d.bs = x1.i))
         - size(array_distinct(transform(filter(_do, x -> x.d.bs = x1.i), x -> x.d.be * 0)))
       + size(filter(_s, q -> q.rs = x1.i and q.k > 1))
       + size(filter(_s, q -> q.rs = x1.i and q.k = 1 and (
           exists(_w, w -> w.bs = q.rs and w.fw = q.c + 1)
           or exists(_b, b -> (b.ls = q.rs and b.le = q.c) or (b.us = q.rs and b.ue = q.c))))))
    """

    def pieces(within: str = "true") -> str:
        def some(p: str) -> str:
            return within.format(p=p)

        return f"""
      concat(
        transform(get(transform(array({parens}), kept -> filter(_t, x -> {some("x.i")} and
                    (x.t not in ('(',')') or exists(kept, g -> g.o = x.i or g.c = x.i))
                    and not exists(_s, q -> q.op = x.i))), 0),
          x1 -> named_struct('key', {outer_key('x1.i', 'array(x1.i)')}, 'p', x1.i, 's', concat(
            repeat('(', {opens}),
            case
              when x1.k = 'w' then concat(
                  if(exists(_w, w -> w.w = x1.i and (w.fw < w.w or exists(_s, q -> q.rs = w.bs and q.c = w.w - 1))),
                     ')', ''), ' where ')
              when x1.t in ('{{','}}') and exists(_g, g -> g.kind = 'where' and (g.o = x1.i or g.c = x1.i)) then ''
              when x1.t = ',' and exists(_g, g -> g.kind = 'where' and g.o = x1.par) then ') where '
              when x1.t = ',' then ', '
              when x1.t in ({_CONSTR}, {_ARITH}) then concat(' ', x1.t, ' ')
              else x1.t end))),
        transform(filter(_s, q -> {some("q.op")}), q -> named_struct(
          'key', {outer_key('q.op', 'array(q.op)')}, 'p', q.op, 's', concat('#', q.op))),
        transform(filter(_s, q -> {some("q.op")}), q -> named_struct('key', {outer_key('q.op', 'array(q.c, q.k, -1)')}, 'p', q.op,
          's', concat(if(q.k > 1, ')', ''), ' where #', q.op, ' ', q.t, ' '))),
        transform(filter(_s, q -> {some("q.op")} and q.k = q.m and exists(_b, b -> (b.ls = q.rs and b.le = q.c) or (b.us = q.rs and b.ue = q.c))),
          q -> named_struct('key', {outer_key('q.op', 'array(q.c, q.k, 2147483647)')}, 'p', q.op, 's', ')')))
    """

    # the pieces of bounds alone: who asks for no unrolled text needs no more
    # or, a bound that is one name being that name, none
    named = lambda lo, hi: f"({lo} = {hi} and coalesce(get(_t_c, {lo}) <= {q}, false))"
    bounded = f"filter(_b, b -> (b.ls >= 0 and not {named('b.ls', 'b.le')}) or (b.us >= 0 and not {named('b.us', 'b.ue')}))"
    in_bound = "exists(_bb, b -> {p} between b.ls and b.le or {p} between b.us and b.ue)"

    def render(lo: str, hi: str, of: str = "_q") -> str:
        return f"array_join(transform(filter({of}, x -> x.p between {lo} and {hi}), x -> x.s), '')"

    def in_order(of: str) -> str:
        # without shorthands nothing is relocated
        return f"if(size(_s) = 0, {of}, sort_array({of}))"

    def bound(lo: str, hi: str) -> str:
        # a bound that is a where type is stored without its parentheses
        return f"if({named(lo, hi)}, get(_src, {lo}), regexp_replace({render(lo, hi)}, '^\\\\((.* where .*)\\\\)$', '$1'))"

    # of each binder what is left without its bounds; who asks for none needs no more
    scopes = """
      transform(_b, (b, id) -> named_struct(
        'occurrs', if(b.npos < 0,
            array(concat(array_repeat('Where', greatest(b.k - 1, 0)), array(get(filter(_i, v -> v.o = b.o), 0).lab))),
            sort_array(filter(_o, x -> x.b = id)).st),
        'context', get(_x, id).lab))
    """
    tv = f"""
      transform(sort_array(transform(_b, (b, id) -> named_struct(
        'ord', get(_x, id).ord,
        'name', b.name,
        'lb', if(b.ls < 0, '{DEFAULT_LB}', {bound('b.ls', 'b.le')}),
        'ub', if(b.us < 0, '{DEFAULT_UB}', {bound('b.us', 'b.ue')}),
        'occurrs', get(_sc, id).occurrs, 'context', get(_sc, id).context))),
      x -> named_struct('name', x.name, 'lb', x.lb, 'ub', x.ub, 'occurrs', x.occurrs, 'context', x.context))
    """

    error = f"""
      size(_src) = 0
      or exists(_ot, x -> x.t in ({_UNSUPPORTED}) or (x.k = {m} and get(_src, x.i + 1) <=> '{{'))
      or exists(_g, g -> g.kind = 'bare' or g.kind = 'square')
      or exists(_b, b -> not b.ok)
      or exists(_w, w -> w.w = w.fw and (w.w <= w.bs))
      or exists(_w, w -> get(_src, w.w + 1) <=> '{{' and get(_src, w.w + 2) <=> '}}')
      or exists(_w, w -> get(_t_c, w.w + 1) is null)
      or exists(_ct, x -> x.i > 0
                and not exists(_s, q -> q.op = x.i) and not exists(_do, d -> exists(d.ops, y -> y.i = x.i))
                and not exists(_u, u -> x.i between u.s and u.e))
      or exists(_nt, i -> i > 0 and (get(_t_c, i - 1) <= {d} or get(_t_c, i - 1) >= {closers[0]} and get(_t_c, i - 1) <= {closers[2]})
                and not ({of('i', n)} and {of('i - 1', d)}))
      or exists(_cm, x -> coalesce({of('x.i - 1', lexical.CURLY_OPEN, lexical.ROUND_OPEN, comma)}, true))
    """
    warning = f"""
      exists(_ot, x -> x.t = '$') or size(_u) > 0
      or exists(_ot, x -> x.t = ':' and not coalesce({of('x.i - 1', n, d)}, false))
      or exists(_g, g -> g.kind = 'curly' and get(_t_c, g.o - 1) > {q})
    """
    return [
        ("_sp", rest), ("_nt", operands), ("_cm", commas), ("_ct", constraints), ("_wt", where_words), ("_ot", others),
        ("_g", groups), ("_u", untraversed), ("_s0", short0), ("_s", shorts), ("_w0", where0),
        ("_w1", where1), ("_w", wheres), ("_d", decls), ("_do", decl_ops), ("_b", binders),
        ("_c", arith), ("_i", intervals), ("_o0", occ0), ("_o", occ), ("_x0", ctx), ("_x", ctx1),
        ("_sc", scopes), ("_bb", bounded), ("_q0", f"if(size(_bb) = 0, null, {pieces(in_bound)})"), ("_q", in_order("_q0")), ("_tv", tv),
        ("_err", error), ("_warn", warning),
        *zip(_UNROLLED, (pieces(), in_order("_r0"), render("0", "size(_t)", "_r"))),
    ]




def sharp_safe(text: Column) -> Column:
    """Text to read: where nothing precedes a ``#``, every ``#`` becomes ``X``."""
    return F.when(
        F.ltrim(text).startswith("#"), F.replace(text, F.lit("#"), F.lit("X"))
    ).otherwise(text)


def _in_groups(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Add the steps, those that read none of each other in one projection."""
    group: dict[str, Column] = {}
    for name, sql in steps:
        if set(group) & set(re.findall(r"\w+", sql)):
            df, group = df.withColumns(group), {}
        group[name] = F.expr(sql)
    return df.withColumns(group)


def _worked_out(df: DataFrame, text: str, plain: Column) -> tuple[DataFrame, dict[str, Column]]:
    """The steps up to the unrolled text, and of these the summary, Error and Warning."""
    df = df.withColumn("_plain", plain)
    df = df.withColumn("_src", F.when(~F.col("_plain"), lexical.snippet_tokens(sharp_safe(F.col(text)))))
    df = _in_groups(df, [*lexical.bracket_steps("_src", "_t"), *[(n, sql) for n, sql in _sources() if n not in _UNROLLED]])
    plain, ok = F.col("_plain"), F.col("_t_p").isNotNull() & ~F.col("_err")
    return df, {
        "TypeVarsSummary": F.when(plain, F.array().cast(TV_TYPE)).when(ok, F.col("_tv")).cast(TV_TYPE),
        "Error": ~plain & ~F.coalesce(ok, F.lit(False)),
        "Warning": ~plain & F.coalesce(~ok | F.col("_warn"), F.lit(True)),
    }


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """Add the unrolled text, null where there is an error."""
    df = _in_groups(df, [(n, sql) for n, sql in _sources() if n in _UNROLLED])
    unrolled = F.when(F.col("_plain"), _tidy(text)).when(~F.col("Error"), F.col("_un"))
    return df.withColumn("UnrolledTypeAnnotation", unrolled)


def _tidy(text: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(text), r"\s+", ""), ",", ", ")


def _is_plain(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(lexical.PLAIN_TYPE), F.lit(False))


def _summarize_rows(df: DataFrame, text: str) -> DataFrame:
    keep = df.columns
    df, found = _worked_out(df, text, _is_plain(text))
    # the text comes after the seal: a generator gives all its fields, so what nobody reads must stay out of it
    df = lexical.sealed(df, [*keep, "_plain", *_UNROLLED_FROM], found)
    return _with_text(df, text).select(*keep, *SUMMARY_COLUMNS)


def summarize(
    df: DataFrame, text: str = "TypeAnnotation", dedupe: bool = False, hot: int = 100_000,
    derive: Callable[[str, str], dict[str, Column]] | None = None,
) -> DataFrame:
    """Add UnrolledTypeAnnotation, TypeVarsSummary, Error and Warning.

    A text that cannot be read gets nulls and true, true.

    ``dedupe`` summarises each distinct text once, in the first of its rows, and
    hands that on to the others by a running window; rows are shuffled once, their
    summaries never. Plain texts (no operator, no variable) are answered in place
    and not shuffled either. The rows of a text that has more than ``hot`` are
    dealt over as many keys as keep each below that, and summarised once a key.

    ``derive`` gives further columns, worked out from a summary alone and, with
    ``dedupe``, handed on with it. Of its two arguments the first names a column
    of summaries, the second one with occurrs and context of the same variables, in
    any order: who reads no others does not pay for names, order and bounds.
    """
    derive = derive or (lambda whole, scopes: {})
    if not dedupe:
        df = _summarize_rows(df, text)
        return df.withColumns(derive("TypeVarsSummary", "TypeVarsSummary"))
    keep = df.columns
    plain, unreadable = _is_plain(text), F.col(text).isNull()
    direct = df.filter(plain | unreadable).select(
        *keep, F.when(~unreadable, _tidy(text)).alias("UnrolledTypeAnnotation"),
        F.when(~unreadable, F.array().cast(TV_TYPE)).cast(TV_TYPE).alias("TypeVarsSummary"),
        unreadable.alias("Error"), unreadable.alias("Warning"))
    hard = df.filter(~plain & ~unreadable)
    # only texts of very many rows, which are few, are dealt over several keys; rows of equal hashes are counted together
    often = hard.groupBy(F.xxhash64(text).alias("_often")).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot)
    parts = F.coalesce(F.ceil(F.col("_n") / F.lit(hot)), F.lit(1))
    dealt = hard.join(F.broadcast(often), F.xxhash64(text) == F.col("_often"), "left").withColumn(
        "_salt", F.pmod(F.monotonically_increasing_id(), parts))
    keys = Window.partitionBy(text, "_salt")
    dealt = dealt.select(*keep, "_salt").repartition(shuffle_width(df.sparkSession), text, "_salt").withColumn(
        "_at", F.row_number().over(keys.orderBy(text, "_salt")))
    # no seal here: no filter comes through the windows
    summed, found = _worked_out(dealt.withColumn("_text", F.when(F.col("_at") == 1, F.col(text))), "_text", F.lit(False))
    summed = _with_text(summed.withColumns(found), "_text").withColumn("_scopes", F.when(~F.col("Error"), F.col("_sc")))
    derived = derive("TypeVarsSummary", "_scopes")
    so_far = keys.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = summed.withColumns({f"_of_{c}": v for c, v in derived.items()}).select(
        *keep, *[F.first(c).over(so_far).alias(c) for c in SUMMARY_COLUMNS],
        *[F.first(f"_of_{c}").over(so_far).alias(f"_of_{c}") for c in derived])
    direct = direct.withColumns({f"_of_{c}": v for c, v in derive("TypeVarsSummary", "TypeVarsSummary").items()})
    return direct.unionByName(found).withColumns({c: F.col(f"_of_{c}") for c in derived}).drop(*[f"_of_{c}" for c in derived])
