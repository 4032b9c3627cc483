"""DuckDB SQL for every named query: an independent statement of the same rules, used as the
correctness oracle.  Arithmetic is written term by term in the same order as the Column
expressions so per-row doubles agree bit for bit; aggregates are compared after rounding.
"""

from __future__ import annotations

from orisite.functions.vec import JACOBI_SWEEPS
from orisite.operators.corrections import RANK_TOLERANCE, ROUNDING
from orisite.plans import derived as D

AX = "xyz"


def dbl(v: float | int) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


class W:
    """Accumulates named CTEs in order and renders ``WITH ... SELECT``."""

    def __init__(self):
        self.ctes: list[tuple[str, str]] = []

    def add(self, name: str, sql: str) -> str:
        self.ctes.append((name, sql))
        return name

    def render(self, final: str) -> str:
        return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in self.ctes) + "\n" + final


# ---- topology and fixture rows ----------------------------------------------------------

def topology(w: W) -> None:
    tm = ", ".join(f"({k}, {s(res)}, {s(name)}, {serial}, {dbl(ox)}, {dbl(oy)}, {dbl(oz)})"
                   for k, res, n in D.KINDS for name, serial, ox, oy, oz in D.TEMPLATE[:n])
    w.add("tmpl", f"SELECT * FROM (VALUES {tm}) t(kind, resname, atomname, serial, ox, oy, oz)")
    w.add("t_atoms0", f"SELECT resname, atomname, serial FROM tmpl WHERE kind <> {D.UNKNOWN_KIND}")
    w.add("t_atoms", "SELECT * FROM t_atoms0 UNION ALL SELECT resname, ' H1 ', max(serial) + 1 FROM t_atoms0 "
                     "GROUP BY resname UNION ALL SELECT resname, ' H3 ', max(serial) + 2 FROM t_atoms0 GROUP BY resname")
    dr = ", ".join(f"({s(r)}, {sid}, {k + 1}, {s(a)})" for r, sid, _, *atoms in D.DIRECTORS for k, a in enumerate(atoms))
    w.add("t_dirs", f"SELECT * FROM (VALUES {dr}) t(resname, siteid, role, atomname)")
    w.add("t_members", "SELECT resname, atomname, CASE WHEN atomname LIKE ' P%' THEN 0 ELSE 1 END AS siteid FROM t_atoms0")
    tt = ", ".join(f"({s(a)}, {k + 1})" for k, a in enumerate(D.TERMINUS[0]))
    w.add("t_term", f"SELECT * FROM (VALUES {tt}) t(atomname, role)")
    cr = ", ".join(f"({s(r)}, {s(a1)}, {s(a2)})" for r, a1, a2 in D.CORRECTIONS)
    w.add("t_corr", f"SELECT * FROM (VALUES {cr}) t(resname, atom1, atom2)")


def jitter(axis: str) -> str:
    a, b, d = D.JITTER[axis]
    q = f"((pk * ({a} + 7 * serial) + sk * ({b} + 11 * serial) + {d} * serial) % {D.JITTER_MOD})"
    return f"((CAST({q} AS DOUBLE) / {dbl(D.JITTER_MOD)} - {dbl(0.5)}) * {dbl(D.JITTER_AMP)})"


def coords(w: W, name: str, src: str) -> str:
    cs = " ".join(f"WHEN {i} THEN {dbl(cn)} / {dbl(cd)}" for i, (cn, cd, sn, sd) in enumerate(D.ROTATIONS))
    ss = " ".join(f"WHEN {i} THEN {dbl(sn)} / {dbl(sd)}" for i, (cn, cd, sn, sd) in enumerate(D.ROTATIONS))
    w.add(f"{name}_0", f"SELECT *, ox + {jitter('x')} AS _x0, oy + {jitter('y')} AS _y0, oz + {jitter('z')} AS _z0, "
                       f"CASE sk % 4 {cs} END AS _c, CASE sk % 4 {ss} END AS _s FROM {src}")
    w.add(f"{name}_1", f"SELECT *, _c * _x0 - _s * _y0 AS x, _s * _x0 + _c * _y0 AS _y1 FROM {name}_0")
    return w.add(name, f"SELECT *, _c * _y1 - _s * _z0 AS y, _s * _y1 + _c * _z0 AS z FROM {name}_1")


def structure_atoms(w: W) -> str:
    w.add("res", "SELECT CAST(l_orderkey AS VARCHAR) AS entry, l_returnflag AS chainid, "
                 f"CAST(l_linenumber + {D.REPEAT_STEP} * (row_number() OVER (PARTITION BY l_orderkey, l_returnflag, "
                 "l_linenumber, l_linestatus ORDER BY l_partkey, l_suppkey) - 1) AS INTEGER) AS resseq, "
                 "l_linestatus AS icode, l_partkey AS pk, l_suppkey AS sk FROM lineitem")
    w.add("sa0", "SELECT r.entry, r.chainid, r.resseq, r.icode, r.pk, r.sk, "
                 f"CASE WHEN r.sk % {D.MIXED_EVERY} = 5 AND t.atomname = {s(D.MIXED_ATOM)} THEN {s(D.MIXED_NAME)} "
                 "ELSE t.resname END AS resname, t.atomname, t.serial, "
                 "t.ox, t.oy, t.oz, CAST(((ascii(r.chainid) * 4096 + r.resseq) * 128 + ascii(r.icode)) * 16 "
                 "+ t.serial AS BIGINT) AS line_no FROM res r JOIN tmpl t "
                 f"ON t.kind = CASE WHEN r.pk % 4 = {D.UNKNOWN_KIND} THEN {D.CLEAN_KIND} ELSE r.pk % 4 END "
                 "WHERE NOT (t.atomname = ' P6 ' AND r.sk % 3 = 0)")
    return coords(w, "satoms", "sa0")


def numbering(w: W, name: str, src: str) -> str:
    w.add(f"{name}_l", f"SELECT *, lag(chainid) OVER w AS _pc, lag(resseq) OVER w AS _pr, lag(icode) OVER w AS _pi "
                       f"FROM {src} WINDOW w AS (PARTITION BY entry ORDER BY line_no)")
    w.add(f"{name}_d", f"SELECT *, CASE WHEN _pc IS NULL THEN 0 WHEN chainid <> _pc THEN 1 "
                       f"WHEN resseq > _pr THEN resseq - _pr WHEN resseq = _pr AND icode <> _pi THEN 1 ELSE 0 END AS _d "
                       f"FROM {name}_l")
    return w.add(name, f"SELECT *, CAST(sum(_d) OVER (PARTITION BY entry ORDER BY line_no ROWS BETWEEN UNBOUNDED "
                       f"PRECEDING AND CURRENT ROW) AS INTEGER) AS rescounter, "
                       f"coalesce(_pc = chainid AND resseq < _pr, false) AS out_of_order FROM {name}_d")


ATOM_COLS = "entry, chainid, resseq, icode, rescounter, resname, atomname, x, y, z"


def fmt(m: str) -> str:
    return (f"lpad((CASE WHEN {m} < 0 THEN '-' ELSE '' END) || CAST((abs({m}) - abs({m}) % 1000) // 1000 AS VARCHAR)"
            f" || '.' || lpad(CAST(abs({m}) % 1000 AS VARCHAR), 3, '0'), 8, ' ')")


def millis(w: W, name: str, src: str) -> str:
    return w.add(name, f"SELECT *, CAST(round(x * {dbl(1000)}) AS BIGINT) AS _mx, CAST(round(y * {dbl(1000)}) AS BIGINT)"
                       f" AS _my, CAST(round(z * {dbl(1000)}) AS BIGINT) AS _mz FROM {src}")


def atom_line(record: str, atomname: str, altloc: str, resname: str, xs: str) -> str:
    return (f"{s(record)} || lpad(CAST(serial AS VARCHAR), 5, ' ') || ' ' || {atomname} || {altloc} || {resname} || ' '"
            f" || chainid || lpad(CAST(resseq AS VARCHAR), 4, ' ') || icode || '   ' || {xs} || {fmt('_my')} || "
            f"{fmt('_mz')} || '  1.00  0.00'")


def structure_lines(w: W) -> str:
    structure_atoms(w)
    millis(w, "sm", "satoms")
    return w.add("slines", f"SELECT DISTINCT entry, CAST(0 AS BIGINT) AS line_no, 'DBREF  ' || entry AS line FROM satoms "
                           f"UNION ALL SELECT entry, line_no, {atom_line('ATOM  ', 'atomname', chr(39) + ' ' + chr(39), 'resname', fmt('_mx'))}"
                           f" AS line FROM sm")


def qc_lines(w: W) -> str:
    w.add("li", "SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS resseq, "
                "l_returnflag AS chainid, l_linestatus AS icode, CAST(l_partkey % 4 AS INTEGER) AS kind FROM lineitem")
    w.add("qa0", "SELECT li.*, t.resname, t.atomname, t.serial, t.ox, t.oy, t.oz FROM li JOIN tmpl t ON t.kind = li.kind "
                 "WHERE NOT (t.atomname = ' P6 ' AND li.sk % 3 = 0)")
    coords(w, "qa1", "qa0")
    millis(w, "qa", "qa1")
    base = "((((pk * 8 + resseq) * 128 + ascii(chainid)) * 128 + ascii(icode)) * 16)"
    name = (f"(CASE WHEN sk % {D.RENAME_EVERY} = 0 AND atomname = {s(D.RENAMED_FROM)} THEN {s(D.RENAMED_TO)} "
            f"ELSE atomname END)")
    alt = f"(CASE WHEN pk % {D.ALTLOC_EVERY} = 0 THEN 'A' ELSE ' ' END)"
    bad = " ".join(f"WHEN {i} THEN {s(x)}" for i, x in enumerate(D.BAD_X))
    xs = (f"(CASE WHEN pk % {D.BAD_X_EVERY} = 0 AND serial = 1 THEN (CASE sk % {len(D.BAD_X)} {bad} END) "
          f"ELSE {fmt('_mx')} END)")
    return w.add("qlines", f"""
        SELECT CAST(ok AS VARCHAR) AS entry, CAST({base} + serial AS BIGINT) AS line_no,
               {atom_line('ATOM  ', name, alt, 'resname', xs)} AS line FROM qa
        UNION ALL
        SELECT CAST(ok AS VARCHAR), CAST({base} + 15 AS BIGINT), {atom_line('HETATM', 'atomname', "' '", "'ZZZ'", fmt('_mx'))}
        FROM qa WHERE sk % {D.HETATM_EVERY} = 0 AND serial = 1
        UNION ALL
        SELECT CAST(ok AS VARCHAR), CAST(0 AS BIGINT), 'DBREF  ' || CAST(ok AS VARCHAR)
        FROM (SELECT DISTINCT ok FROM li) e WHERE ok % {D.NO_DBREF_EVERY} <> 0
        UNION ALL
        SELECT CAST(ok AS VARCHAR), CAST((ok * 31) % {D.MODEL_SLOT_MOD} * {D.QC_PART_SHIFT} AS BIGINT), 'MODEL        1'
        FROM (SELECT DISTINCT ok FROM li) e WHERE ok % {D.MODEL_EVERY} = 0""")


def number(field: str) -> str:
    """A decimal number with blanks around it, else NULL."""
    return (f"CASE WHEN regexp_full_match(trim({field}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN try_cast(trim({field}) AS DOUBLE) END")


def records(w: W, name: str, src: str) -> str:
    w.add(f"{name}_0", f"SELECT entry, line_no, substr(line, 1, 6) AS record, line, length(line) AS len FROM {src} "
                       f"WHERE substr(line, 1, 6) IN ('ATOM  ', 'MODEL ', 'DBREF ', 'DBREF1')")
    w.add(f"{name}_1", f"""SELECT entry, line_no, record, len,
        CASE WHEN record = 'ATOM  ' THEN substr(line, 17, 1) END AS altloc,
        CASE WHEN record = 'ATOM  ' THEN substr(line, 13, 4) END AS atomname,
        CASE WHEN record = 'ATOM  ' THEN substr(line, 18, 3) END AS resname,
        CASE WHEN record = 'ATOM  ' THEN substr(line, 22, 1) END AS chainid,
        CASE WHEN record = 'ATOM  ' THEN try_cast(substr(line, 23, 4) AS INTEGER) END AS resseq,
        CASE WHEN record = 'ATOM  ' THEN substr(line, 27, 1) END AS icode,
        CASE WHEN record = 'ATOM  ' THEN {number("substr(line, 31, 8)")} END AS x,
        CASE WHEN record = 'ATOM  ' THEN {number("substr(line, 39, 8)")} END AS y,
        CASE WHEN record = 'ATOM  ' THEN {number("substr(line, 47, 8)")} END AS z
        FROM {name}_0""")
    return w.add(name, f"""SELECT *, CASE
        WHEN record = 'ATOM  ' AND (len <= 16 OR (altloc = ' ' AND (len <= 26 OR resseq IS NULL))) THEN 0
        WHEN record = 'ATOM  ' AND altloc = ' ' AND (x IS NULL OR y IS NULL OR z IS NULL) THEN 5 END AS malformed_at
        FROM {name}_1""")


def quality(w: W, p: str, recs: str) -> None:
    """Defines ``{p}num`` (numbered atoms), ``{p}dup``, ``{p}err``, ``{p}clean``."""
    w.add(f"{p}atoms", f"SELECT * FROM {recs} WHERE record = 'ATOM  ' AND altloc = ' ' "
                       f"AND (malformed_at IS NULL OR malformed_at > 0)")
    numbering(w, f"{p}num0", f"{p}atoms")
    w.add(f"{p}num", f"SELECT n.*, kr.resname IS NOT NULL AS res_known, ka.resname IS NOT NULL AS atom_known "
                     f"FROM {p}num0 n LEFT JOIN (SELECT DISTINCT resname FROM t_atoms) kr ON kr.resname = n.resname "
                     f"LEFT JOIN (SELECT DISTINCT resname, atomname FROM t_atoms) ka "
                     f"ON ka.resname = n.resname AND ka.atomname = n.atomname")
    w.add(f"{p}dup", f"SELECT entry, chainid, rescounter, atomname, line_no, CAST(occurrence AS INTEGER) AS occurrence "
                     f"FROM (SELECT *, row_number() OVER (PARTITION BY entry, chainid, rescounter, atomname "
                     f"ORDER BY line_no) AS occurrence FROM {p}num) d WHERE occurrence > 1")
    w.add(f"{p}cand", f"""
        SELECT entry, line_no, 0 AS check_order, 'Ensemble of models' AS reason FROM {recs} WHERE record = 'MODEL '
        UNION ALL SELECT entry, line_no, 0, 'Malformed ATOM record' FROM {recs} WHERE malformed_at = 0
        UNION ALL SELECT entry, fa, 1, 'No DBREF entry found' FROM (
            SELECT entry, min(CASE WHEN record = 'ATOM  ' AND altloc = ' ' THEN line_no END) AS fa,
                   min(CASE WHEN record IN ('DBREF ', 'DBREF1') THEN line_no END) AS fd FROM {recs} GROUP BY entry) f
            WHERE fa IS NOT NULL AND (fd IS NULL OR fd > fa)
        UNION ALL SELECT entry, line_no, 2, 'Residue indices out of order' FROM {p}num WHERE out_of_order
        UNION ALL SELECT entry, line_no, 3, 'Residue not among the known amino acids' FROM {p}num WHERE NOT res_known
        UNION ALL SELECT entry, line_no, 4, 'Unknown atom' FROM {p}num WHERE res_known AND NOT atom_known
        UNION ALL SELECT entry, line_no, 5, 'Malformed ATOM record' FROM {recs} WHERE malformed_at = 5
        UNION ALL SELECT entry, line_no, 6, 'Duplicate atom' FROM {p}dup""")
    w.add(f"{p}err", f"SELECT entry, arg_min(reason, (line_no, check_order)) AS reason FROM {p}cand GROUP BY entry")
    w.add(f"{p}clean", f"SELECT {ATOM_COLS} FROM {p}num WHERE entry NOT IN (SELECT entry FROM {p}err)")


# ---- analysis chain ----------------------------------------------------------------------

def v(prefix: str, suffix: str = "") -> list[str]:
    return [f"{prefix}{a}{suffix}" for a in AX]


def dot(a: list[str], b: list[str]) -> str:
    return f"{a[0]} * {b[0]} + {a[1]} * {b[1]} + {a[2]} * {b[2]}"


def cross(a: list[str], b: list[str]) -> list[str]:
    return [f"{a[1]} * {b[2]} - {a[2]} * {b[1]}", f"{a[2]} * {b[0]} - {a[0]} * {b[2]}",
            f"{a[0]} * {b[1]} - {a[1]} * {b[0]}"]


def eigenvalues(w: W, name: str, src: str, sym: list[list[str]]) -> None:
    """``name``: the rows of ``src`` with _ev0 >= _ev1 >= _ev2, the eigenvalues of ``sym``."""
    at = {(i, j): f"_jac{i}{j}" for i in range(3) for j in range(i, 3)}
    k = lambda i, j: at[min(i, j), max(i, j)]
    w.add(f"{name}_0", "SELECT *, " + ", ".join(f"{sym[i][j]} AS {n}" for (i, j), n in at.items()) + f" FROM {src}")
    last, off = f"{name}_0", ", ".join(f"{n}" for n in (*at.values(), "_theta", "_t", "_c"))
    for step in range(3 * JACOBI_SWEEPS):
        p, q = ((0, 1), (0, 2), (1, 2))[step % 3]
        r, n = 3 - p - q, f"{name}_{step + 1}"
        w.add(f"{n}a", f"SELECT *, CASE WHEN {k(p, q)} <> 0 THEN ({k(q, q)} - {k(p, p)}) / (2.0 * {k(p, q)}) END AS _theta FROM {last}")
        w.add(f"{n}b", f"SELECT *, CASE WHEN _theta IS NULL THEN 0.0::DOUBLE WHEN _theta >= 0 THEN 1.0 / (_theta + sqrt(_theta * _theta + 1.0)) "
                       f"ELSE -1.0 / (sqrt(_theta * _theta + 1.0) - _theta) END AS _t FROM {n}a")
        w.add(f"{n}c", f"SELECT *, 1.0 / sqrt(_t * _t + 1.0) AS _c FROM {n}b")
        new = {k(p, p): f"{k(p, p)} - _t * {k(p, q)}", k(q, q): f"{k(q, q)} + _t * {k(p, q)}", k(p, q): "0.0::DOUBLE",
               k(r, p): f"_c * {k(r, p)} - _t * _c * {k(r, q)}", k(r, q): f"_t * _c * {k(r, p)} + _c * {k(r, q)}"}
        last = w.add(n, f"SELECT * EXCLUDE ({off}), " + ", ".join(f"{new.get(c, c)} AS {c}" for c in at.values()) + f" FROM {n}c")
    d = [at[i, i] for i in range(3)]
    w.add(name, f"SELECT *, list_sort([{', '.join(d)}])[3] AS _ev0, list_sort([{', '.join(d)}])[2] AS _ev1, "
                f"list_sort([{', '.join(d)}])[1] AS _ev2 FROM {last}")


def fit(w: W, p: str, pairs: str) -> None:
    """Defines ``{p}cov`` from ``pairs``."""
    ys, ps = ["yx", "yy", "yz"], ["px", "py", "pz"]
    sname = {}
    for i in range(3):
        for j in range(i, 3):
            sname[(i, j)] = sname[(j, i)] = f"_s{i}{j}"
    aggs = ([f"avg({y}) AS pos_difference_av_{a}" for y, a in zip(ys, AX)]
            + [f"avg({q}) AS predicted_pos_av_{a}" for q, a in zip(ps, AX)]
            + [f"covar_pop({ys[i]}, {ps[j]}) AS cov_cross_{AX[i]}{AX[j]}" for i in range(3) for j in range(3)]
            + [f"covar_pop({ps[i]}, {ps[j]}) AS _s{i}{j}" for i in range(3) for j in range(i, 3)])
    w.add(f"{p}cov0", f"SELECT resname, atomname, {', '.join(aggs)} FROM {pairs} GROUP BY resname, atomname")
    w.add(f"{p}cov1", f"SELECT *, " + ", ".join(f"{sname[(i, j)]} AS cov_self_{AX[i]}{AX[j]}"
                                               for i in range(3) for j in range(3)) + f" FROM {p}cov0")
    S = [[f"cov_self_{AX[i]}{AX[j]}" for j in range(3)] for i in range(3)]
    C = [[f"cov_cross_{AX[i]}{AX[j]}" for j in range(3)] for i in range(3)]
    eigenvalues(w, f"{p}cove", f"{p}cov1", S)
    mean = v("predicted_pos_av_")
    least = f"greatest(_ev0 * {dbl(RANK_TOLERANCE)}, ({dot(mean, mean)}) * {dbl(ROUNDING ** 2)})"
    w.add(f"{p}covr", "SELECT *, " + " + ".join(f"CAST(_ev{k} > {least} AS INTEGER)" for k in range(3)) + f" AS rank FROM {p}cove")
    cs = [cross(S[1], S[2]), cross(S[2], S[0]), cross(S[0], S[1])]
    w.add(f"{p}cov2", f"SELECT *, " + ", ".join(f"{cs[k][j]} AS _c{k}{j}" for k in range(3) for j in range(3))
                      + f" FROM {p}covr")
    w.add(f"{p}cov3", f"SELECT *, {dot(S[0], ['_c00', '_c01', '_c02'])} AS _det FROM {p}cov2")
    w.add(f"{p}cov4", f"SELECT *, CASE WHEN rank = 3 THEN _ev0 / _ev2 END AS condition, "
                      + ", ".join(f"CASE WHEN rank = 3 THEN _c{k}{j} / nullif(_det, 0) END AS _q{k}{j}" for k in range(3) for j in range(3))
                      + f" FROM {p}cov3")
    w.add(f"{p}cov5", f"SELECT *, " + ", ".join(f"{dot(C[i], [f'_q0{j}', f'_q1{j}', f'_q2{j}'])} AS slope{AX[i]}{AX[j]}"
                                               for i in range(3) for j in range(3)) + f" FROM {p}cov4")
    icpt = ", ".join(f"pos_difference_av_{AX[i]} - ({dot([f'slope{AX[i]}{c}' for c in AX], mean)}) "
                     f"AS intercept{AX[i]}" for i in range(3))
    cov_cols = (["resname", "atomname"] + v("pos_difference_av_") + mean
                + [C[i][j] for i in range(3) for j in range(3)] + [S[i][j] for i in range(3) for j in range(3)])
    w.add(f"{p}cov", f"SELECT {', '.join(cov_cols)}, {icpt}, "
                     + ", ".join(f"slope{a}{b}" for a in AX for b in AX) + f", rank, condition FROM {p}cov5")


def analysis(w: W, atoms: str, legacy_y: bool = False, p: str = "") -> None:
    """Defines ``{p}pdb, {p}pos, {p}cg, {p}rel, {p}mom, {p}lab, {p}pred, {p}pairs, {p}cov,
    {p}resid, {p}rmsd`` from a clean numbered atom table."""
    w.add(f"{p}ends", f"SELECT entry, chainid, max(rescounter) AS rescounter FROM {atoms} GROUP BY entry, chainid")
    w.add(f"{p}marked", f"SELECT a.*, e.entry IS NOT NULL AS is_end FROM {atoms} a LEFT JOIN {p}ends e "
                        f"ON a.entry = e.entry AND a.chainid = e.chainid AND a.rescounter = e.rescounter")
    w.add(f"{p}pdb", f"SELECT m.*, CASE WHEN m.is_end AND t.atomname IS NOT NULL THEN -1 ELSE mb.siteid END AS siteid "
                     f"FROM {p}marked m LEFT JOIN t_members mb ON mb.resname = m.resname AND mb.atomname = m.atomname "
                     f"LEFT JOIN (SELECT DISTINCT atomname FROM t_term) t ON t.atomname = m.atomname")
    w.add(f"{p}roles", "SELECT resname, atomname, siteid, role FROM t_dirs "
                       "UNION ALL SELECT NULL, atomname, -1, role FROM t_term")
    w.add(f"{p}hits", f"SELECT a.entry, a.chainid, a.rescounter, r.siteid, r.role, a.resname, a.x, a.y, a.z "
                      f"FROM {p}pdb a JOIN {p}roles r ON a.atomname = r.atomname "
                      f"AND (r.resname = a.resname OR (r.resname IS NULL AND a.is_end))")
    picks = ", ".join(f"max(CASE WHEN role = {k} THEN {c} END) AS a{k}{c}" for k in (1, 2, 3) for c in AX)
    w.add(f"{p}pos", f"SELECT entry, chainid, rescounter, siteid, max(CASE WHEN role = 1 THEN resname END) AS resname, "
                     f"{picks} FROM {p}hits GROUP BY entry, chainid, rescounter, siteid")
    key = "entry, chainid, rescounter"
    w.add(f"{p}cg0", f"SELECT {key}, resname, siteid, a1x AS x, a1y AS y, a1z AS z, "
                     + ", ".join(f"a2{c} - a1{c} AS _d1{c}" for c in AX) + ", "
                     + ", ".join(f"a3{c} - a1{c} AS _d2{c}" for c in AX) + f" FROM {p}pos")
    w.add(f"{p}cg1", f"SELECT *, sqrt({dot(v('_d1'), v('_d1'))}) AS _n1 FROM {p}cg0")
    w.add(f"{p}cg2", f"SELECT *, " + ", ".join(f"_d1{c} / nullif(_n1, 0) AS ex{c}" for c in AX) + f" FROM {p}cg1")
    w.add(f"{p}cg3", f"SELECT *, {dot(v('ex'), v('_d2'))} AS _proj FROM {p}cg2")
    w.add(f"{p}cg4", f"SELECT *, " + ", ".join(f"_d2{c} - ex{c} * _proj AS _u{c}" for c in AX) + f" FROM {p}cg3")
    w.add(f"{p}cg5", f"SELECT *, sqrt({dot(v('_u'), v('_u'))}) AS _n2 FROM {p}cg4")
    w.add(f"{p}cg6", f"SELECT *, " + ", ".join(f"_u{c} / nullif(_n2, 0) AS ey{c}" for c in AX) + f" FROM {p}cg5")
    ez = cross(v("ex"), v("ey"))
    frame = ", ".join(f"e{r}{c}" for r in AX for c in AX)
    w.add(f"{p}cg", f"SELECT {key}, resname, siteid, x, y, z, exx, exy, exz, eyx, eyy, eyz, "
                    + ", ".join(f"{e} AS ez{c}" for e, c in zip(ez, AX))
                    + f" FROM {p}cg6 WHERE _n1 > 0 AND _n2 > 0 AND eyx IS NOT NULL")
    w.add(f"{p}rel0", f"SELECT a.entry, a.chainid, a.rescounter, a.resname, a.siteid, a.atomname, "
                      f"a.x - c.x AS x, a.y - c.y AS y, a.z - c.z AS z, "
                      + ", ".join(f"c.e{r}{cc} AS e{r}{cc}" for r in AX for cc in AX)
                      + f" FROM {p}pdb a JOIN {p}cg c ON a.entry = c.entry AND a.chainid = c.chainid "
                        f"AND a.rescounter = c.rescounter AND a.siteid = c.siteid")
    w.add(f"{p}rel", f"SELECT entry, chainid, rescounter, resname, siteid, atomname, x, y, z, "
                     + ", ".join(f"{dot(v('e' + r), ['x', 'y', 'z'])} AS oriented{r}" for r in AX) + f" FROM {p}rel0")
    w.add(f"{p}mom0", f"SELECT resname, siteid, atomname, avg(orientedx) AS x, avg(orientedy) AS y, avg(orientedz) AS z, "
                      f"stddev_pop(orientedx) AS dx, stddev_pop(orientedy) AS dy, stddev_pop(orientedz) AS dz, "
                      f"count(orientedx) AS count FROM {p}rel GROUP BY resname, siteid, atomname")
    w.add(f"{p}mom", f"SELECT resname, siteid, atomname, x, y, z, dx, dy, dz, sqrt(dx * dx + dy * dy + dz * dz) AS rmsd, "
                     f"count FROM {p}mom0")
    fy = "m.y" if legacy_y else "m.x"
    w.add(f"{p}lab", f"SELECT c.entry, c.chainid, c.rescounter, m.resname, m.atomname AS correctingatomname, "
                     f"c.x + m.x * c.exx + m.y * c.eyx + m.z * c.ezx AS x, "
                     f"c.y + {fy} * c.exy + m.y * c.eyy + m.z * c.ezy AS y, "
                     f"c.z + m.x * c.exz + m.y * c.eyz + m.z * c.ezz AS z "
                     f"FROM {p}cg c JOIN {p}mom m ON c.resname = m.resname AND c.siteid = m.siteid "
                     f"WHERE c.siteid >= 0 AND EXISTS (SELECT 1 FROM t_corr k WHERE k.resname = m.resname "
                     f"AND k.atom2 = m.atomname)")
    w.add(f"{p}corr2", "SELECT c.resname, c.atom2 AS correctingatomname, c.atom1 AS correctedatomname, m.siteid AS site "
                       "FROM t_corr c JOIN t_members m ON m.resname = c.resname AND m.atomname = c.atom1")
    w.add(f"{p}pred0", f"SELECT g.entry, g.chainid, g.rescounter, g.resname, g.siteid, k.correctedatomname, "
                       f"l.x - g.x AS _dx, l.y - g.y AS _dy, l.z - g.z AS _dz, "
                       + ", ".join(f"g.e{r}{cc} AS e{r}{cc}" for r in AX for cc in AX)
                       + f" FROM {p}lab l JOIN {p}corr2 k ON l.resname = k.resname "
                         f"AND l.correctingatomname = k.correctingatomname "
                         f"JOIN {p}cg g ON g.entry = l.entry AND g.chainid = l.chainid AND g.rescounter = l.rescounter "
                         f"AND g.siteid = k.site AND g.resname = k.resname")
    w.add(f"{p}pred", f"SELECT entry, chainid, rescounter, resname, siteid, correctedatomname, "
                      + ", ".join(f"{dot(v('e' + r), ['_dx', '_dy', '_dz'])} AS {r}" for r in AX) + f" FROM {p}pred0")
    w.add(f"{p}pairs", f"SELECT r.entry, r.chainid, r.rescounter, r.atomname, r.resname, r.siteid, "
                       f"r.orientedx - m.x AS yx, r.orientedy - m.y AS yy, r.orientedz - m.z AS yz, "
                       f"q.x AS px, q.y AS py, q.z AS pz FROM {p}rel r JOIN {p}mom m ON m.resname = r.resname "
                       f"AND m.siteid = r.siteid AND m.atomname = r.atomname JOIN {p}pred q ON q.entry = r.entry "
                       f"AND q.chainid = r.chainid AND q.rescounter = r.rescounter AND q.correctedatomname = r.atomname")
    fit(w, p, f"{p}pairs")
    fits = [f"(k.intercept{a} + k.slope{a}x * q.px + k.slope{a}y * q.py + k.slope{a}z * q.pz)" for a in AX]
    w.add(f"{p}resid", f"SELECT q.entry, q.chainid, q.rescounter, q.resname, q.siteid, q.atomname, "
                       + ", ".join(f"q.y{a} - {f} AS {a}" for a, f in zip(AX, fits))
                       + f" FROM {p}pairs q JOIN {p}cov k ON k.resname = q.resname AND k.atomname = q.atomname "
                         f"WHERE q.siteid >= 0")
    w.add(f"{p}direct", "SELECT resname, atomname FROM t_atoms a WHERE NOT EXISTS (SELECT 1 FROM t_corr c "
                        "WHERE c.resname = a.resname AND c.atom1 = a.atomname)")
    w.add(f"{p}drmsd", f"SELECT resname, siteid, atomname, dx, dy, dz, rmsd, count FROM {p}mom m WHERE EXISTS "
                       f"(SELECT 1 FROM {p}direct d WHERE d.resname = m.resname AND d.atomname = m.atomname)")
    w.add(f"{p}crmsd", f"SELECT resname, siteid, atomname, sqrt(_mx) AS dx, sqrt(_my) AS dy, sqrt(_mz) AS dz, "
                       f"sqrt(_mx + _my + _mz) AS rmsd, count FROM (SELECT resname, siteid, atomname, avg(x * x) AS _mx, "
                       f"avg(y * y) AS _my, avg(z * z) AS _mz, count(x) AS count FROM {p}resid WHERE x IS NOT NULL "
                       f"GROUP BY resname, siteid, atomname) g")
    w.add(f"{p}rmsd", f"SELECT * FROM {p}drmsd UNION ALL SELECT * FROM {p}crmsd")


# ---- named queries -------------------------------------------------------------------------

def out(src: str, cols: list[str], doubles: list[str], digits: int = 6) -> str:
    items = [f"round({c}, {digits}) + 0.0 AS {c}" if c in doubles else c for c in cols]
    return f"SELECT {', '.join(items)} FROM {src}"


XYZ = ["x", "y", "z"]
FRAME = [f"e{r}{c}" for r in AX for c in AX]
REL = ["entry", "chainid", "rescounter", "resname", "siteid", "atomname", "x", "y", "z",
       "orientedx", "orientedy", "orientedz"]
MOM = ["resname", "siteid", "atomname", "x", "y", "z", "dx", "dy", "dz", "rmsd", "count"]
RMSD = ["resname", "siteid", "atomname", "dx", "dy", "dz", "rmsd", "count"]
COV = (["resname", "atomname"] + v("pos_difference_av_") + v("predicted_pos_av_")
       + [f"cov_cross_{a}{b}" for a in AX for b in AX] + [f"cov_self_{a}{b}" for a in AX for b in AX]
       + v("intercept") + [f"slope{a}{b}" for a in AX for b in AX] + ["rank", "condition"])
NONDBL = {"resname", "atomname", "entry", "chainid", "siteid", "rescounter", "count", "resseq", "icode",
          "line_no", "altloc", "rank", "correctingatomname", "correctedatomname", "reason", "occurrence"}


def _analysis_query(final_cte: str, cols: list[str], legacy_y: bool = False) -> str:
    w = W()
    topology(w)
    structure_atoms(w)
    numbering(w, "num", "satoms")
    w.add("atoms", f"SELECT {ATOM_COLS} FROM num")
    analysis(w, "atoms", legacy_y)
    return w.render(out(final_cte, cols, [c for c in cols if c not in NONDBL]))


def _qc_query(final: str, cols: list[str]) -> str:
    w = W()
    topology(w)
    qc_lines(w)
    records(w, "recs", "qlines")
    quality(w, "q", "recs")
    return w.render(out(final, cols, [c for c in cols if c not in NONDBL]))


def queries() -> dict[str, str]:
    atom_cols = ATOM_COLS.split(", ")
    q: dict[str, str] = {}
    q["number_residues"] = _analysis_query("atoms", atom_cols)
    q["chain_ends"] = _analysis_query("ends", ["entry", "chainid", "rescounter"])
    q["site_positions"] = _analysis_query(
        "pos", ["entry", "chainid", "rescounter", "siteid", "resname"] + [f"a{k}{c}" for k in (1, 2, 3) for c in AX])
    q["orient_sites"] = _analysis_query("cg", ["entry", "chainid", "rescounter", "resname", "siteid"] + XYZ + FRAME)
    q["assign_sites"] = _analysis_query("pdb", atom_cols + ["siteid"])
    q["to_site_frame"] = _analysis_query("rel", REL)
    q["frame_moments"] = _analysis_query("mom", MOM)
    q["from_site_frame"] = _analysis_query(
        "lab", ["entry", "chainid", "rescounter", "resname", "correctingatomname"] + XYZ)
    q["corrected_predictor"] = _analysis_query(
        "pred", ["entry", "chainid", "rescounter", "resname", "siteid", "correctedatomname"] + XYZ)
    q["regression_pairs"] = _analysis_query(
        "pairs", ["entry", "chainid", "rescounter", "atomname", "resname", "siteid", "yx", "yy", "yz", "px", "py", "pz"])
    q["fit_corrections"] = _analysis_query("cov", COV)
    q["fit_corrections_legacy_y"] = _analysis_query("cov", COV, legacy_y=True)
    q["apply_corrections"] = _analysis_query(
        "resid", ["entry", "chainid", "rescounter", "resname", "siteid", "atomname"] + XYZ)
    q["direct_rmsd"] = _analysis_query("drmsd", RMSD)
    q["corrected_rmsd"] = _analysis_query("crmsd", RMSD)
    q["rmsd_report"] = _analysis_query("rmsd", RMSD)
    q["rmsd_report_legacy_y"] = _analysis_query("rmsd", RMSD, legacy_y=True)

    q["scan_atoms"] = _qc_query(
        "(SELECT * FROM recs WHERE record = 'ATOM  ' AND altloc = ' ' AND malformed_at IS NULL) s",
        ["entry", "line_no", "altloc", "atomname", "resname", "chainid", "resseq", "icode"] + XYZ)
    q["entry_errors"] = _qc_query("qerr", ["entry", "reason"])
    q["clean_atoms"] = _qc_query("qclean", atom_cols)
    q["duplicate_atoms"] = _qc_query(
        "qdup", ["entry", "chainid", "rescounter", "atomname", "line_no", "occurrence"])

    w = W()
    topology(w)
    structure_lines(w)
    records(w, "precs", "slines")
    quality(w, "p", "precs")
    analysis(w, "pclean", p="a_")
    q["pipeline_rmsd"] = w.render(out("a_rmsd", RMSD, ["dx", "dy", "dz", "rmsd"]))
    q["pipeline_errors"] = q["entry_errors"]

    w = W()
    topology(w)
    qc_lines(w)
    folder = f"CAST(entry AS BIGINT) // {D.FILE_ORDERS}"
    w.add("flines", f"SELECT {folder} AS entry, row_number() OVER (PARTITION BY {folder} ORDER BY entry, line_no, line) - 1 "
                    f"AS line_no, line FROM qlines")
    records(w, "frecs", "flines")
    q["read_files"] = w.render(out("(SELECT entry AS folder, * EXCLUDE (entry) FROM frecs) f", [
        "folder", "line_no", "record", "altloc", "atomname", "resname", "chainid", "resseq", "icode"] + XYZ + [
        "malformed_at"], XYZ))
    q["written_report"] = q["rmsd_report"]

    w = W()
    topology(w)
    structure_atoms(w)
    numbering(w, "num", "satoms")
    w.add("atoms", f"SELECT {ATOM_COLS} FROM num")
    analysis(w, "atoms")
    shapes = " UNION ALL ".join(
        f"SELECT resname, atomname, {s(name)} AS variant, yx, yy, yz, {x} AS qx, {y} AS qy, {z} AS qz FROM pairs"
        for name, (x, y, z) in D.PREDICTOR_SHAPES.items())
    w.add("shapes", shapes)
    w.add("turned0", f"SELECT *, {dbl(3)} / {dbl(5)} * qx - {dbl(4)} / {dbl(5)} * qy AS rx, {dbl(4)} / {dbl(5)} * qx + {dbl(3)} / {dbl(5)} * qy AS ry FROM shapes")
    w.add("turned", f"SELECT *, {dbl(5)} / {dbl(13)} * ry - {dbl(12)} / {dbl(13)} * qz AS sy, "
                    f"{dbl(12)} / {dbl(13)} * ry + {dbl(5)} / {dbl(13)} * qz AS sz FROM turned0")
    w.add("moved", " UNION ALL ".join(
        f"SELECT resname, atomname || ':' || variant || ':{k}' AS atomname, yx, yy, yz, (rx + {dbl(D.PREDICTOR_SHIFT[0])}) * {dbl(f)} AS px, "
        f"(sy + {dbl(D.PREDICTOR_SHIFT[1])}) * {dbl(f)} AS py, (sz + {dbl(D.PREDICTOR_SHIFT[2])}) * {dbl(f)} AS pz FROM turned"
        for k, f in D.PREDICTOR_SCALES.items()))
    fit(w, "m_", "moved")
    factor = " ".join(f"WHEN {s(k)} THEN {dbl(f)}" for k, f in D.PREDICTOR_SCALES.items())
    w.add("ranks", f"SELECT resname, split_part(atomname, ':', 1) AS atomname, split_part(atomname, ':', 2) AS variant, "
                   f"split_part(atomname, ':', 3) AS scale, rank, condition, slopexx IS NOT NULL AS fitted, "
                   f"slopexx * CASE split_part(atomname, ':', 3) {factor} END AS slope FROM m_cov")
    q["fit_ranks"] = w.render("SELECT resname, atomname, variant, scale, rank, round(condition, 4) + 0.0 AS condition, fitted, "
                              "round(slope, 5) + 0.0 AS slope FROM ranks")
    q["direct_atoms"] = _analysis_query("drmsd", ["resname", "siteid", "atomname", "count"])

    q.update(layout_queries())
    return q


def layout_queries() -> dict[str, str]:
    res3 = "('R' || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0'))"
    d = lambda e: f"CAST(({e}) % 10 AS VARCHAR)"
    groups = " || ".join(
        f"CAST((l_suppkey + {i}) % 2 AS VARCHAR) || "
        + " || ".join(f"' C' || {d(f'l_partkey + {3 * i + k}')} || ' '" for k in (1, 2, 3)) for i in range(3))
    q = {}
    q["site_director_layout"] = f"""
        WITH dl AS (SELECT {res3} || CAST(1 + l_linenumber % 3 AS VARCHAR) || {groups} AS line FROM lineitem),
        n AS (SELECT line, try_cast(substr(line, 4, 1) AS INTEGER) AS n FROM dl),
        e AS (SELECT line, CAST(unnest(range(0, n)) AS INTEGER) AS siteid FROM n WHERE n > 0)
        SELECT substr(line, 1, 3) AS resname, siteid, try_cast(substr(line, 5 + 13 * siteid, 1) AS INTEGER) AS sitetype,
               substr(line, 6 + 13 * siteid, 4) AS atom1, substr(line, 10 + 13 * siteid, 4) AS atom2,
               substr(line, 14 + 13 * siteid, 4) AS atom3 FROM e"""
    mg = " || ".join(f"' M' || {d(f'l_partkey + {i}')} || ' ' || CAST((l_suppkey + {i}) % 3 AS VARCHAR)" for i in range(8))
    q["site_member_layout"] = f"""
        WITH ml AS (SELECT substr({res3} || {mg}, 1, CAST(3 + 5 * l_linenumber + l_suppkey % 5 AS INTEGER)) AS line
                    FROM lineitem),
        n AS (SELECT line, (length(line) - 3) // 5 AS n FROM ml WHERE (length(line) - 3) % 5 <> 4),
        e AS (SELECT line, unnest(range(0, n)) AS i FROM n WHERE n > 0)
        SELECT substr(line, 1, 3) AS resname, substr(line, 4 + 5 * i, 4) AS atomname,
               try_cast(substr(line, 8 + 5 * i, 1) AS INTEGER) AS siteid FROM e"""
    q["correction_layout"] = f"""
        WITH cl AS (SELECT {res3} || ' C' || {d('l_partkey')} || ' ' || ' C' || {d('l_suppkey')} || ' ' AS line
                    FROM lineitem)
        SELECT substr(line, 1, 3) AS resname, substr(line, 4, 4) AS atom1, substr(line, 8, 4) AS atom2 FROM cl
        WHERE length(line) > 0"""
    q["terminus_layout"] = f"""
        WITH tl AS (SELECT CAST(l_orderkey AS VARCHAR) AS entry, CAST(l_linenumber - 1 AS BIGINT) AS line_no,
                           ' T' || {d('l_partkey')} || ' ' AS line FROM lineitem)
        SELECT entry, """ + ", ".join(
        f"max(CASE WHEN line_no = {k} THEN substr(line, 1, 4) END) AS atom{k + 1}" for k in range(3)) + \
        " FROM tl GROUP BY entry"
    sound_terminus = q["terminus_layout"] + " HAVING count(DISTINCT line_no) FILTER (line_no IN (0, 1, 2)) = 3"
    full = {"directors": f"{res3} || CAST(1 + l_linenumber % 3 AS VARCHAR) || {groups}",
            "members": f"substr({res3} || {mg}, 1, CAST(3 + 5 * l_linenumber + l_suppkey % 5 AS INTEGER))",
            "corrections": f"{res3} || ' C' || {d('l_partkey')} || ' ' || ' C' || {d('l_suppkey')} || ' '",
            "terminus": f"' T' || {d('l_partkey')} || ' '"}
    bad = "CASE l_suppkey % 6 WHEN 1 THEN substr(line, 1, CAST(l_partkey % 20 + 2 AS INTEGER)) WHEN 2 THEN substr(line, 1, 3) || 'x' || substr(line, 5) " \
          "WHEN 3 THEN '   ' WHEN 4 THEN substr(line, 1, 5) || '    ' || substr(line, 10) WHEN 5 THEN substr(line, 1, 3) || '    ' || substr(line, 8) " \
          "ELSE line END"
    some = lambda n, test: f"len(list_filter(range(0, greatest({n}, 1)), lambda i: {test})) > 0"
    blank = lambda at: f"trim(substr(line, {at}, 4)) = ''"
    n = "try_cast(substr(line, 4, 1) AS INTEGER)"
    m = "((length(line) - 3) // 5)"
    fault = {
        "directors": f"CASE WHEN {n} IS NULL THEN 'unreadable site count' WHEN {n} = 0 THEN 'no sites' WHEN length(line) < 13 * {n} + 4 THEN 'line too short' "
                     f"WHEN {some(n, 'try_cast(substr(line, 5 + 13 * i, 1) AS INTEGER) IS NULL')} THEN 'unreadable site type' "
                     f"WHEN {some(n, ' OR '.join(blank(f'{6 + 4 * k} + 13 * i') for k in range(3)))} THEN 'blank atom name' END",
        "members": f"CASE WHEN {m} < 1 THEN 'no members' WHEN (length(line) - 3) % 5 = 4 THEN 'cut member' "
                   f"WHEN {some(m, 'try_cast(substr(line, 8 + 5 * i, 1) AS INTEGER) IS NULL')} THEN 'unreadable site id' "
                   f"WHEN {some(m, blank('4 + 5 * i'))} THEN 'blank atom name' END",
        "corrections": f"CASE WHEN length(line) < 11 THEN 'line too short' WHEN {blank(4)} OR {blank(8)} THEN 'blank atom name' END"}
    lines = ", ".join(f"{k}_l AS (SELECT l_orderkey, l_linenumber, {bad} AS line FROM (SELECT *, {v} AS line FROM lineitem) x)" for k, v in full.items())
    judged = ", ".join(f"{k}_j AS (SELECT *, {f} AS reason FROM {k}_l WHERE trim(line) <> '')" for k, f in fault.items())
    term = """terminus_g AS (SELECT l_orderkey AS entry, max(CASE WHEN l_linenumber = 1 THEN line END) AS a0,
        max(CASE WHEN l_linenumber = 2 THEN line END) AS a1, max(CASE WHEN l_linenumber = 3 THEN line END) AS a2 FROM terminus_l GROUP BY entry),
        terminus_j AS (""" + " UNION ALL ".join(
        f"SELECT entry, coalesce(a{k}, '') AS line, CASE WHEN a{k} IS NULL THEN 'missing line' WHEN length(a{k}) < 4 OR trim(substr(a{k}, 1, 4)) = '' "
        f"THEN 'short atom name' END AS reason FROM terminus_g" for k in range(3)) + ")"
    q["layout_rejects"] = f"WITH {lines}, {judged}, {term} " + " UNION ALL ".join(
        f"SELECT '{k}' AS layout, line, reason FROM {k}_j WHERE reason IS NOT NULL" for k in full)
    text = lambda *cols: " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    q["layout_rows"] = f"""WITH {lines}, {judged}, {term},
        dg AS (SELECT line, CAST(unnest(range(0, {n})) AS INTEGER) AS i FROM directors_j WHERE reason IS NULL),
        mg AS (SELECT line, unnest(range(0, {m})) AS i FROM members_j WHERE reason IS NULL)
        SELECT 'directors' AS layout, {text("substr(line, 6 + 13 * i, 4)", "substr(line, 10 + 13 * i, 4)", "substr(line, 14 + 13 * i, 4)",
                                            "substr(line, 1, 3)", "i", "CAST(substr(line, 5 + 13 * i, 1) AS INTEGER)")} AS "row" FROM dg
        UNION ALL SELECT 'members', {text("substr(line, 4 + 5 * i, 4)", "substr(line, 1, 3)", "CAST(substr(line, 8 + 5 * i, 1) AS INTEGER)")} FROM mg
        UNION ALL SELECT 'corrections', {text("substr(line, 4, 4)", "substr(line, 8, 4)", "substr(line, 1, 3)")} FROM corrections_j WHERE reason IS NULL
        UNION ALL SELECT 'terminus', {text("substr(a0, 1, 4)", "substr(a1, 1, 4)", "substr(a2, 1, 4)", "entry")} FROM terminus_g
        WHERE entry NOT IN (SELECT entry FROM terminus_j WHERE reason IS NOT NULL)"""
    tl = f"""tl AS (
        SELECT CAST(l_orderkey AS VARCHAR) AS entry, CAST(l_linenumber AS BIGINT) AS line_no,
               'ATOM  ' || lpad(CAST(l_linenumber AS VARCHAR), 5, ' ') || ' '
               || (CASE WHEN l_linenumber = 1 THEN ' N  ' ELSE ' C' || {d('l_partkey')} || ' ' END)
               || ' ' || 'R' || lpad(CAST(l_orderkey % 100 AS VARCHAR), 2, '0')
               || ' A   1      0.000   0.000   0.000  1.00 20.00' AS line FROM lineitem
        UNION ALL
        SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber + 100 AS BIGINT),
               'CONECT' || lpad(CAST(l_linenumber AS VARCHAR), 5, ' ') || """ + " || ".join(
        f"(CASE WHEN 1 + l_suppkey % 4 > {i} THEN lpad(CAST((l_partkey + {i}) % 100 AS VARCHAR), 5, ' ') ELSE '' END)"
        for i in range(4)) + """ || (CASE WHEN l_suppkey % 7 = 0 THEN '  ' ELSE '' END) FROM lineitem)"""
    apf = ("apf AS (SELECT entry, line_no, substr(line, 18, 3) AS resname, substr(line, 13, 4) AS atomname, "
           "try_cast(substr(line, 7, 5) AS INTEGER) AS serial FROM tl WHERE substr(line, 1, 6) = 'ATOM  ')")
    q["template_atoms"] = f"""WITH {tl}, {apf}, a AS (SELECT resname, atomname, serial FROM apf)
        SELECT * FROM a UNION ALL SELECT resname, ' H1 ', max(serial) + 1 FROM a GROUP BY resname
        UNION ALL SELECT resname, ' H3 ', max(serial) + 2 FROM a GROUP BY resname"""
    slot = lambda k: f"try_cast(substr(line, {12 + 5 * k}, 5) AS INTEGER)"
    q["scan_bonds"] = f"""WITH {tl}, {apf},
        cn AS (SELECT entry, line_no, line, length(line) AS len FROM tl WHERE substr(line, 1, 6) = 'CONECT'),
        pb AS (SELECT entry, try_cast(substr(line, 7, 5) AS INTEGER) AS selfserial, {slot(0)} AS serial1,
                      CASE WHEN len >= 17 THEN {slot(1)} END AS serial2, CASE WHEN len >= 22 THEN {slot(2)} END AS serial3,
                      CASE WHEN len >= 27 THEN {slot(3)} END AS serial4,
                      ((len - 11) % 5 <> 0 OR len < 16) AS malformed FROM cn),
        res AS (SELECT entry, arg_max(resname, line_no) AS resname, max(serial) AS m FROM apf GROUP BY entry),
        nn AS (SELECT entry, serial AS n FROM apf WHERE atomname = ' N  '),
        h AS (SELECT r.resname, nn.n, r.m + 1 AS h FROM res r JOIN nn ON nn.entry = r.entry
              UNION ALL SELECT r.resname, nn.n, r.m + 2 FROM res r JOIN nn ON nn.entry = r.entry)
        SELECT r.resname, b.selfserial, b.serial1, b.serial2, b.serial3, b.serial4, b.malformed
        FROM pb b JOIN res r ON r.entry = b.entry
        UNION ALL SELECT resname, n, h, NULL, NULL, NULL, false FROM h
        UNION ALL SELECT resname, h, n, NULL, NULL, NULL, false FROM h"""
    q["bond_edges"] = "SELECT resname, selfserial AS src, dst FROM (" + " UNION ALL ".join(
        f"SELECT resname, selfserial, serial{k} AS dst FROM ({q['scan_bonds']}) b{k} WHERE NOT malformed" for k in (1, 2, 3, 4)) + ") e WHERE dst IS NOT NULL"
    q["bond_faults"] = f"""WITH e AS (SELECT DISTINCT * FROM ({q['bond_edges']}) x), a AS (SELECT DISTINCT resname, serial FROM ({q['template_atoms']}) y)
        SELECT *, 'unknown source' AS fault FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.resname = e.resname AND a.serial = e.src)
        UNION ALL SELECT *, 'unknown target' FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.resname = e.resname AND a.serial = e.dst)
        UNION ALL SELECT *, 'one-way' FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.resname = e.resname AND b.src = e.dst AND b.dst = e.src)"""
    keyed = {"atoms": (q["template_atoms"], "resname || '|' || atomname"),
             "directors": (q["site_director_layout"], "resname || '|' || CAST(siteid AS VARCHAR)"),
             "members": (q["site_member_layout"], "resname || '|' || atomname"), "corrections": (q["correction_layout"], "resname || '|' || atom1"),
             "terminus": (f"SELECT * EXCLUDE (entry) FROM ({sound_terminus}) t", "''")}
    q["topology_conflicts"] = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {key} AS key, count(*) AS rows, count(DISTINCT r) AS variants FROM ({sql}) r GROUP BY ALL HAVING count(*) > 1"
        for t, (sql, key) in keyed.items())
    return q


ORACLE = queries()
