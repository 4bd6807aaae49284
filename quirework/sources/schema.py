"""Schemas of the document tables, as DDL."""

from __future__ import annotations

RECT = "struct<x:double,y:double,width:double,height:double>"
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
COLOUR = "struct<r:double,g:double,b:double,a:double>"
COMMANDS = "array<struct<type:string,x1:double,y1:double,cx1:double,cy1:double,cx2:double,cy2:double>>"
RUN = f"struct<start:bigint,length:bigint,font_family:string,font_size:double,color:{COLOUR},bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,letter_spacing:double,word_spacing:double,baseline_shift:double>"
TEXT = f"struct<text:string,runs:array<{RUN}>,line_height:double,alignment:int,first_line_indent:double,left_indent:double,right_indent:double,space_before:double,space_after:double>"
IMAGE = "struct<blob_id:bigint,display_width:double,display_height:double,interpolation:int>"
VECTOR = f"struct<commands:{COMMANDS},fill_rule:string,fill:struct<color:{COLOUR}>,stroke:struct<color:{COLOUR},width:double>>"
CELL = f"struct<row:int,col:int,row_span:int,col_span:int,bounds:{RECT},child_element_indices:array<bigint>>"
TABLE = f"struct<rows:int,cols:int,row_heights:array<double>,col_widths:array<double>,cells:array<{CELL}>,border_width:double,border_color:{COLOUR},child_elements:array<bigint>>"
MEDIA = "struct<source_uri:string,type:string,auto_play:boolean,loop:boolean>"
GROUP = "struct<child_element_indices:array<bigint>>"
METADATA = "map<string,variant>"

DOCUMENT = f"id bigint, title string, author string, subject string, keywords string, creator string, creation_date timestamp, modification_date timestamp, next_id bigint, modified boolean, metadata {METADATA}"
TAB = f"id bigint, doc_id bigint, name string, page_indices array<bigint>, metadata {METADATA}"
PAGE = f"page_id bigint, doc_id bigint, page_idx bigint, width double, height double, margin_top double, margin_bottom double, margin_left double, margin_right double, background {COLOUR}, modified boolean, metadata {METADATA}"
ELEMENT = f"element_id bigint, page_id bigint, ord bigint, bounds {RECT}, transform {MATRIX}, z_index int, opacity double, clip_path {COMMANDS}, visible boolean, selected boolean, locked boolean, kind string, text {TEXT}, image {IMAGE}, vector {VECTOR}, table {TABLE}, media {MEDIA}, group {GROUP}, metadata {METADATA}"
IMAGE_BLOB = "blob_id bigint, raw_bytes binary, format string, width int, height int, color_space string"
VIEWPORT = "viewport_id bigint, scroll_x double, scroll_y double, zoom double, page_spacing int, screen_width int, screen_height int"
COMMAND_LOG = "doc_id bigint, seq bigint, op string, element_id bigint, page_idx bigint, payload variant"

TABLES = {"document": DOCUMENT, "tab": TAB, "page": PAGE, "element": ELEMENT, "image_blob": IMAGE_BLOB, "viewport": VIEWPORT, "command_log": COMMAND_LOG}
#: Alternatives of an element's content; exactly one of the six structs is set, named like the kind.
KINDS = ("text", "image", "vector", "table", "media", "group")
