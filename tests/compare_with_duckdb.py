"""Compare registered queries with their SQL: compare_with_duckdb.py <sf0.01> [name or prefix* ...]"""
import sys, time, math, duckdb
from pathlib import Path
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from pyspark.sql import SparkSession
import __spark_entry__ as E
sf=sys.argv[1]; names=sys.argv[2:]
s=(SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions","8").config("spark.ui.enabled","false")
   .config("spark.driver.memory","8g").config("spark.ui.showConsoleProgress","false").getOrCreate())
s.sparkContext.setLogLevel("ERROR")
d=f'/root/testdata/{sf}'
con=duckdb.connect()
for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
    con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
qs=E.queries(); os_=E.oracle_sql()
def norm(v):
    if v is None: return None
    if isinstance(v,bool): return v
    if isinstance(v,float):
        return 'nan' if math.isnan(v) else v+0.0
    if isinstance(v,list): return tuple(norm(x) for x in v)
    return v
sel=[q for q in qs if not names or any(q==n or (n.endswith('*') and q.startswith(n[:-1])) for n in names)]
bad=[]
for q in sel:
    t=time.time()
    try:
        df=qs[q](s,d); cols=sorted(df.columns); rows=[tuple(norm(r[c]) for c in cols) for r in df.collect()]
    except Exception as e:
        print("ERR",q,str(e)[:1500]); bad.append(q); continue
    ts=time.time()-t
    if q not in os_:
        print(f"rows-only {q} {len(rows)} {ts:.2f}s", rows[:1]); continue
    t=time.time()
    try:
        r=con.execute(os_[q]); dc=[c[0] for c in r.description]; dr=r.fetchall(); types=dict(zip(dc,[str(c[1]) for c in r.description]))
    except Exception as e:
        print("SQLERR",q,str(e)[:800]); bad.append(q); continue
    td=time.time()-t
    if sorted(dc)!=cols: print("COLS",q,cols,sorted(dc)); bad.append(q); continue
    idx=[dc.index(c) for c in cols]; dr=[tuple(norm(x[i]) for i in idx) for x in dr]
    k=lambda r: tuple(str(x) for x in r)
    a=sorted(rows,key=k); b=sorted(dr,key=k)
    sty=dict(df.dtypes)
    if a==b and all(type(x)==type(y) for ra,rb in zip(a[:50],b[:50]) for x,y in zip(ra,rb)):
        print(f"ok {q} rows={len(a)} spark={ts:.2f}s duck={td:.2f}s")
        if not rows: print("   EMPTY")
    else:
        bad.append(q)
        sa,sb=set(map(str,a)),set(map(str,b))
        print("DIFF",q,len(a),len(b),"cols",cols,[sty[c] for c in cols],[types[c] for c in cols])
        print("  spark-only",sorted(sa-sb)[:4]); print("  duck-only ",sorted(sb-sa)[:4])
print("BAD",bad, "of",len(sel))
